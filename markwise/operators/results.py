"""Ranked matches as tables and nested documents: flattening, filters, top matches and pair lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from markwise.functions.names import animal, ratio, side, strip_suffix

MATCH = T.StructType([T.StructField("match_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lnbnn_score", T.DoubleType()), T.StructField("inliers", T.LongType()), T.StructField("total_matches", T.LongType())])
RESULTS = T.MapType(T.StringType(), T.ArrayType(MATCH))


def nest(matches: DataFrame) -> DataFrame:
    """(query_id, matches): each query's matches from the best on; one row per query, as a JSON line each."""
    own = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in MATCH])))
    return matches.groupBy("query_id").agg(F.transform(own, lambda x: F.struct(*[x[f.name].alias(f.name) for f in MATCH])).alias("matches"))


def flatten(nested: DataFrame) -> DataFrame:
    """The table of matches from (query_id, matches); queries without matches vanish."""
    rows = nested.select("query_id", F.explode("matches").alias("m")).select("query_id", "m.*")
    return rows.select(
        strip_suffix("query_id").alias("query_id"), side("query_id").alias("query_side"), strip_suffix("match_id").alias("match_id"), side("match_id").alias("match_side"),
        "score", "inliers", "total_matches", ratio(F.col("inliers"), F.col("total_matches")).alias("inlier_ratio"), "lnbnn_score",
    )


def drop_same_animal(matches: DataFrame) -> DataFrame:
    return matches.where(animal("query_id") != animal("match_id"))


def top_matches(matches: DataFrame, query: str, n: int = 5) -> DataFrame:
    return matches.where(F.col("query_id") == query).orderBy(F.desc("score"), "match_id").limit(n)


def rank_n(matches: DataFrame, n: int = 1) -> DataFrame:
    """The n-th match of every query that has so many."""
    own = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return matches.withColumn("rank", F.row_number().over(own)).where(F.col("rank") == n)


def pair(matches: DataFrame, a: str, b: str) -> DataFrame:
    """The row of a pair, in the given direction if there is one, else in the other."""
    forward = (F.col("query_id") == a) & (F.col("match_id") == b)
    back = (F.col("query_id") == b) & (F.col("match_id") == a)
    return matches.where(forward | back).orderBy(F.when(forward, 0).otherwise(1)).limit(1)


def pair_text(matches: DataFrame) -> DataFrame:
    """A line of text per match, as a caption of the pair's figure; numbers are rounded by their exact binary value, as printf does."""
    shown = lambda x, pattern: F.call_function("format_number", x, F.lit(pattern))
    score, share = shown(F.col("score"), "0.0000"), shown(F.col("inlier_ratio") * 100, "0.0")
    return matches.withColumn("caption", F.format_string("%s vs %s: score %s, %d of %d inliers (%s%%)", "query_id", "match_id", score, "inliers", "total_matches", share))


def first_matches(matches: DataFrame, n: int = 5) -> DataFrame:
    """The best match of each of the first n queries, by name, for a run's report."""
    best = matches.groupBy("query_id").agg(F.max_by(F.struct("match_id", "score"), F.struct("score", F.col("match_id"))).alias("b"))
    return best.select("query_id", "b.match_id", "b.score").orderBy("query_id").limit(n)
