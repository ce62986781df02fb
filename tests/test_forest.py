"""Randomised k-d trees: their planes, bounds, recall over checks, and the ratio test by them."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from markwise.operators import forest, knn, matching
from markwise.plans import surrogates
from markwise.plans.matching import pairwise
from markwise.sources.settings import Matching


def test_leaves_part_the_points():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(200, 6)), np.ones((20, 6))])
    nodes, cuts, leaves = forest.tree(x, np.random.default_rng(2))
    assert sorted(np.concatenate(leaves).tolist()) == list(range(220))
    assert max(map(len, leaves)) == 20 and len(nodes) == len(cuts) == len(leaves) - 1
    q = r.normal(size=(30, 6))
    low = forest.bounds(q, np.array(nodes), np.array(cuts), len(leaves))
    assert ((low == 0).sum(1) == 1).all()  # each query is in one leaf
    for leaf, own in enumerate(leaves):  # planes of several dimensions: no farther than the nearest member, in each plane's own dimension
        assert (low[:, leaf] <= len(nodes) * ((q[:, None] - x[own][None]) ** 2).sum(-1).min(1) + 1e-9).all()


def test_equal_points_and_one_point():
    for x in (np.zeros((50, 3)), np.zeros((1, 3))):
        nodes, _, leaves = forest.tree(x, np.random.default_rng(0))
        assert nodes == [] and len(leaves) == 1 and len(leaves[0]) == len(x)


def sets(df):
    return {(r.query_id, r.match_id, r.query_idx, r.train_idx) for r in df.collect()}


def test_recall_grows_with_checks(spark, sf):
    d, q = surrogates.descriptors(spark, sf), surrogates.resight(spark, sf)
    exact = sets(matching.ratio_matches(q, d))
    grown = forest.grow(d).cache()
    recall = []
    for checks in (10, 50, 200, 1 << 20):
        got = sets(matching.ratio_matches(q, d, near=forest.nearest_in_images(q, grown, 2, checks)))
        recall.append(len(got & exact) / len(exact))
    assert recall == sorted(recall) and recall[1] >= 0.9 and recall[3] == 1
    assert sets(matching.ratio_matches(q, d, near=forest.nearest_in_images(q, grown, 2, 1 << 20))) == exact


def test_neighbours_are_exact_if_all_are_checked(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 3, size=(90, 5)).astype(float)  # many ties
    rows = [(f"i{k % 4}" if k < 89 else "alone", k, x[k].tolist()) for k in range(90)]
    d = spark.createDataFrame(rows, "image_id string, global_idx long, d array<double>").repartition(3)
    q = d.select(F.col("global_idx").alias("qid"), "d")
    key = lambda df: {(a.qid, a.image_id, a.global_idx, a.rank) for a in df.collect()}
    got = key(forest.nearest_in_images(q, forest.grow(d), 3, 1 << 20))
    assert got == key(knn.nearest_by_label(q, d, 3, "image_id"))
    assert forest.nearest_in_images(q, forest.grow(d.limit(0)), 3).count() == 0
    some = forest.nearest_in_images(q, forest.grow(d), 1, 1).collect()
    assert len(some) == 90 * 5 and len(forest.nearest_in_images(q.limit(0), forest.grow(d), 1).collect()) == 0


@pytest.mark.parametrize("checks", [0, 60])
def test_pairwise_by_forests(spark, checks):
    r = np.random.default_rng(2)
    base, points, rows = r.normal(size=(3, 40, 16)), r.uniform(0, 200, size=(3, 40, 2)), []
    for animal in range(3):
        for sight in range(2):
            for i in range(40):
                px, py = points[animal, i] + sight * np.array([10, 5])
                rows.append((f"a{animal}_{sight}", i, float(px), float(py), (base[animal, i] + 0.02 * r.normal(size=16)).tolist()))
    features = spark.createDataFrame(rows, "image_id string, local_idx long, x double, y double, d array<double>")
    found = pairwise(features, None, Matching(flann_checks=checks)).where("rank = 1").collect()
    assert {(m.query_id, m.match_id) for m in found} == {(f"a{k}_{s}", f"a{k}_{1 - s}") for k in range(3) for s in range(2)}
    assert min(m.inliers for m in found) >= 36


def test_large_images_meet_shares_of_the_queries_in_tasks_of_their_own(spark, sf, monkeypatch):
    """Few images are no longer one block's, and so one task's, work; the rows are the same."""
    from markwise.plans import surrogates

    d = surrogates.descriptors(spark, sf)
    q = surrogates.resight(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(forest.nearest_in_images(q, forest.grow(d), 2))
    monkeypatch.setattr(forest, "QUERIES", 16)
    monkeypatch.setattr(forest, "BLOCKS", 2)
    monkeypatch.setattr(forest, "LARGE", 1)
    found = forest.nearest_in_images(q, forest.grow(d), 2)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString() and rows(found) == whole


def image(x, trees=5):
    nodes, cuts, leaves, first = [], [], [], []
    for t in range(trees):
        a, b, c = forest.tree(x, np.random.default_rng(t))
        first.append((len(a), len(c)))
        nodes, cuts, leaves = nodes + a, cuts + b, leaves + c
    head = np.array([trees, *np.ravel(first)], "<i4").tobytes()
    row = {"image_id": "a", "ids": np.arange(len(x)).astype("<i8"), "vectors": x.astype("<f8"), "cuts": np.array(cuts), "leaves": np.array([len(m) for m in leaves], "<i4"), "members": np.concatenate(leaves).astype("<i4")}
    return forest._Image({k: v if k == "image_id" else v.tobytes() for k, v in row.items()} | {"nodes": head + np.array(nodes, "<i4").tobytes()}, x.shape[1])


def test_best_bins_are_the_first_of_all_leaves():
    """Kept beside the paths or sorted out of all bounds, the leaves are the same and in the same order, ties and full places included."""
    r = np.random.default_rng(7)
    grid = np.array(np.meshgrid(*[[0.0, 1.0]] * 7)).reshape(7, -1).T
    for x in (r.normal(size=(400, 6)), r.integers(0, 3, size=(400, 5)).astype(float), grid, np.exp(8 * r.normal(size=(300, 3))), np.ones((20, 2))):
        some, q = image(x), np.concatenate([x[::9], x[:20] + 0.5, r.normal(size=(20, x.shape[1]))])
        for checks in (1, 7, 60):
            i, leaf = forest._visited_of_all(q, some, checks)
            met = np.cumsum(some.sizes[leaf]) - some.sizes[leaf]
            near = met - met[np.searchsorted(i, i)] < checks
            for room in (checks + 6, 4 * checks + 256):
                got = forest._visited(q, some, checks, room)
                assert np.array_equal(got[0], i[near]) and np.array_equal(got[1], leaf[near])


def test_memory_of_a_search_does_not_grow_with_queries_times_leaves(spark):
    """An image of 12,000 members has some 24,000 leaves in five trees: 98 MB for the bounds of 512 queries, and as much again for what is made of them."""
    r = np.random.default_rng(11)
    x = r.normal(size=(12_000, 8))
    d = spark.createDataFrame(pd.DataFrame({"image_id": "a", "global_idx": np.arange(len(x)), "d": x.tolist()}))
    row = forest.grow(d).collect()[0].asDict()
    some = forest._Image(row, 8) if hasattr(forest, "_Image") else row
    tracemalloc.start()
    i, ids, d2 = forest._search(x[:512], some, 2, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6 and len(i) == 1024 and (ids[::2] == np.arange(512)).all() and (d2[::2] == 0).all()


def test_trees_of_equal_numbers_end():
    """Means of equal numbers are rounded, and so may lie above all of them."""
    x = np.repeat(np.random.default_rng(5).normal(size=(60, 4)), 9, axis=0)
    for seed in range(3):
        leaves = forest.tree(x, np.random.default_rng(seed))[2]
        assert sorted(np.concatenate(leaves).tolist()) == list(range(540)) and all(len(m) <= 4 or (x[m] == x[m[0]]).all() for m in leaves)


def test_vectors_keep_their_precision(spark):
    d = spark.createDataFrame([("a", i, [float(i), 0.5]) for i in range(9)], "image_id string, global_idx long, d array<double>")
    q = d.select(F.col("global_idx").alias("qid"), "d")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    narrow = forest.grow(d.withColumn("d", F.col("d").cast("array<float>")))
    assert len(narrow.collect()[0]["vectors"]) == 72 and rows(forest.nearest_in_images(q, narrow, 2)) == rows(forest.nearest_in_images(q, forest.grow(d), 2))
