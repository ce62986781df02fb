"""The matching pipelines, from tables of features to ranked matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.operators import forest
from markwise.operators import matching as m
from markwise.operators.pq import Index
from markwise.operators.verify import verify
from markwise.sources.settings import Matching
from markwise.sources.tables import exists, scratch


def _sides(features: DataFrame, wanted: DataFrame | None, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and database with global indices, those of the index if there is one; features: (image_id, local_idx, x, y, d)."""
    valid = features.where(F.col("local_idx").isNotNull())
    m.check_descriptors(valid)
    table = index.images() if index else m.offsets(valid)
    database = valid.join(table.select("image_id", "offset"), "image_id").withColumn("global_idx", F.col("offset") + F.col("local_idx")).drop("offset")
    own = database if wanted is None else database.join(wanted.select("image_id").distinct(), "image_id", "left_semi")
    return own.select(F.col("global_idx").alias("qid"), F.col("image_id").alias("query_id"), F.col("local_idx").alias("query_idx"), "d"), database


def stored_index(features: DataFrame, path: str, anew: bool = False) -> Index:
    """The index in that folder with all images of the features: trained on them if there is none, else grown by those it hasn't."""
    valid = features.where(F.col("local_idx").isNotNull())
    if anew or not exists(features.sparkSession, f"{path}/centers"):
        m.check_descriptors(valid)
        index = Index.create(valid.select(F.xxhash64("image_id", "local_idx").alias("global_idx"), "d"), path)
    else:
        index = Index(features.sparkSession, path)
    index.add(valid)
    return index


def one_vs_many(features: DataFrame, queries: DataFrame | None = None, settings: Matching = Matching(), index: Index | None = None) -> DataFrame:
    """(query_id, match_id, score, lnbnn_score, inliers, total_matches, rank); queries: image_ids, else all.

    index: a stored index that has the features' images; its search takes the place of the exact one.
    """
    own, database = _sides(features, queries, index)
    search = (lambda q, n: index.search(q, n, settings.probes, settings.refine)) if index else None
    voted = m.votes(m.survivors(own, database, settings.k, search=search))
    top = m.top_candidates(m.scores(voted), settings.top_candidates).drop("rank", "n_matches")
    pairs = voted.select("query_id", F.col("image_id").alias("match_id"), "query_idx", "train_idx").join(top.select("query_id", "match_id"), ["query_id", "match_id"], "left_semi")
    points = m.with_points(pairs, database, database)
    checked = verify(points, settings.geometric_model, settings.ransac_threshold, settings.confidence, settings.max_iterations)
    counts = own.groupBy("query_id").agg(F.count("*").alias("n_query"))
    return m.ranked(top.join(checked.drop("transform"), ["query_id", "match_id"]), counts, settings.min_inliers).drop("n_query")


def pairwise(features: DataFrame, queries: DataFrame | None = None, settings: Matching = Matching()) -> DataFrame:
    """(query_id, match_id, score, inliers, total_matches, rank): ratio test and verification of every pair.

    With flann_checks in the settings, neighbours come from a forest of k-d trees per image, so many of whose members are checked.
    """
    own, database = _sides(features, queries)
    near = None
    if settings.flann_checks:
        path = scratch(features.sparkSession, "forests")
        forest.grow(database, settings.flann_trees).write.parquet(path)
        near = forest.nearest_in_images(own, features.sparkSession.read.parquet(path), 2, settings.flann_checks)
    points = m.with_points(m.ratio_matches(own, database, settings.ratio_threshold, near), database, database)
    checked = verify(points, settings.geometric_model, settings.ransac_threshold, settings.confidence, settings.max_iterations).where(F.col("inliers") >= settings.min_inliers)
    return m.top_candidates(checked.withColumn("score", m.inlier_score(F.col("inliers"), F.col("total_matches"))).drop("transform"), 1 << 30, "score")
