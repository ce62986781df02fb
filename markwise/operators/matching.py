"""One-vs-many scoring, the ratio test, and the ranking of candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .knn import nearest, nearest_by_label


def check_descriptors(descriptors: DataFrame, dim: int | None = None) -> int:
    """The one length of all descriptors; ValueError for none, for several, or for another than dim."""
    got = descriptors.agg(F.count("*").alias("n"), F.count("image_id").alias("named"), F.min(F.size("d")).alias("a"), F.max(F.size("d")).alias("b")).first()
    if not got["n"]:
        raise ValueError("no descriptors")
    if got["named"] != got["n"]:
        raise ValueError("descriptors without an image")
    if got["a"] != got["b"] or dim not in (None, got["a"]):
        raise ValueError(f"descriptors of {got['a']} to {got['b']} numbers, wanted {dim or 'one length'}")
    return got["a"]


def survivors(queries: DataFrame, database: DataFrame, k: int = 5, exclude_own: bool = True, search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Neighbours of each query descriptor with both images; the query's own image is dropped after the ranking.

    queries: (qid, query_id, query_idx, d); database: (global_idx, image_id, local_idx, d). Excluding takes 5 neighbours
    more, and all that are left count. search: another way to the nearest than the exact one, from (qid, d) and their number to
    (qid, global_idx, image_id, local_idx, d2, rank); images that aren't in the database are then left out.
    """
    wanted = k + 1 + 5 * exclude_own
    if search:
        near = search(queries.select("qid", "d"), wanted).join(database.select("image_id").distinct(), "image_id", "left_semi")
    else:
        near = nearest(queries.select("qid", "d"), database.select("global_idx", "d"), wanted).join(database.select("global_idx", "image_id", "local_idx"), "global_idx")
    named = near.join(queries.select("qid", "query_id", "query_idx"), "qid")
    return named.where(F.col("image_id") != F.col("query_id")) if exclude_own else named


def votes(found: DataFrame) -> DataFrame:
    """One vote per query descriptor at most: for the nearest image, by how much nearer it is than the next image.

    A descriptor whose nearest two images tie, or that found one image only, votes for none.
    """
    best = found.groupBy("query_id", "qid", "query_idx", "image_id").agg(F.min("d2").alias("d2"), F.min_by("local_idx", F.struct("d2", "global_idx")).alias("train_idx"), F.min_by("global_idx", F.struct("d2", "global_idx")).alias("global_idx"))
    own = W.Window.partitionBy("qid").orderBy("d2", "image_id")
    ranked = best.withColumn("r", F.row_number().over(own)).withColumn("other", F.lead("d2").over(own))
    return ranked.where((F.col("r") == 1) & (F.col("d2") < F.col("other"))).select("query_id", "qid", "query_idx", "image_id", "train_idx", "global_idx", "d2", (F.col("other") - F.col("d2")).alias("vote"))


def scores(voted: DataFrame) -> DataFrame:
    return voted.groupBy("query_id", F.col("image_id").alias("match_id")).agg(F.sum("vote").alias("lnbnn_score"), F.count("*").alias("n_matches"))


def top_candidates(scored: DataFrame, n: int = 20, by: str = "lnbnn_score") -> DataFrame:
    own = W.Window.partitionBy("query_id").orderBy(F.desc(by), "match_id")
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n)


def combined_score(lnbnn: Column, n_query: Column, inliers: Column) -> Column:
    return lnbnn / F.greatest(n_query, F.lit(1)) + inliers


def inlier_score(inliers: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(inliers.cast("double"))


def ranked(candidates: DataFrame, counts: DataFrame, min_inliers: int = 10) -> DataFrame:
    """Candidates with inliers, by lnbnn_score per query descriptor plus inliers; counts: (query_id, n_query)."""
    j = candidates.where(F.col("inliers") >= min_inliers).join(counts, "query_id")
    j = j.withColumn("score", combined_score(F.col("lnbnn_score"), F.col("n_query"), F.col("inliers")))
    return top_candidates(j.drop("rank"), 1 << 30, "score")


def ratio_matches(queries: DataFrame, database: DataFrame, ratio: float = 0.75, near: DataFrame | None = None, **blocks) -> DataFrame:
    """Lowe's test in every pair of different images: (query_id, match_id, query_idx, train_idx, distance).

    near: (qid, image_id, global_idx, d2, rank) of the two nearest in each image, found another way than exactly.

    The two nearest of each image come from the blocked search, so no table of all pairs of descriptors is made. Its two rows per
    query descriptor and image are still quadratic in the images: the alternative to the one-vs-many search.
    """
    if near is None:
        near = nearest_by_label(queries.select("qid", "d"), database.select("global_idx", "image_id", "d"), 2, "image_id", **blocks)
    best = near.groupBy("qid", F.col("image_id").alias("match_id")).agg(F.min_by("global_idx", "rank").alias("global_idx"), F.min("d2").alias("d2"), F.max("d2").alias("second"), F.count("*").alias("n"))
    best = best.withColumn("distance", F.sqrt("d2")).where((F.col("n") == 2) & (F.col("distance") < F.sqrt("second") * ratio))
    named = best.join(queries.select("qid", "query_id", "query_idx"), "qid").where(F.col("query_id") != F.col("match_id"))
    return named.join(database.select("global_idx", F.col("local_idx").alias("train_idx")), "global_idx").select("query_id", "match_id", "query_idx", "train_idx", "distance")


def offsets(descriptors: DataFrame) -> DataFrame:
    """(image_id, image_idx, n_desc, offset): places of the images' descriptors in one matrix, in order of image_id.

    The window has one row per image that has descriptors.
    """
    counts = descriptors.groupBy("image_id").agg(F.count("*").alias("n_desc"))
    order = W.Window.orderBy("image_id")
    before = F.coalesce(F.sum("n_desc").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("image_id", (F.row_number().over(order) - 1).alias("image_idx"), "n_desc", before.alias("offset"))


def to_local(matches: DataFrame, table: DataFrame) -> DataFrame:
    """train_idx from positions in the matrix: only rows inside their own image stay."""
    j = matches.join(table.select(F.col("image_id").alias("match_id"), "n_desc", "offset"), "match_id")
    return j.where("position >= offset and position < offset + n_desc").withColumn("train_idx", F.col("position") - F.col("offset")).drop("n_desc", "offset")


def with_points(matches: DataFrame, query_points: DataFrame, database_points: DataFrame) -> DataFrame:
    """Correspondences with both key points; points: (image_id, local_idx, x, y)."""
    a = query_points.select(F.col("image_id").alias("query_id"), F.col("local_idx").alias("query_idx"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    b = database_points.select(F.col("image_id").alias("match_id"), F.col("local_idx").alias("train_idx"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return matches.join(a, ["query_id", "query_idx"]).join(b, ["match_id", "train_idx"])
