"""Matching against literal loops, and the errors of wrong input."""

import tracemalloc

import numpy as np
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from markwise.kernels.ransac import apply, ransac
from markwise.operators import knn, matching, results, verify


def frame(spark, vectors, images):
    seen, rows = {}, []
    for i, (v, im) in enumerate(zip(vectors, images, strict=True)):
        rows.append((im, i, seen.get(im, 0), [float(x) for x in v]))
        seen[im] = seen.get(im, 0) + 1
    return spark.createDataFrame(rows, "image_id string, global_idx long, local_idx long, d array<double>")


def queries(d):
    return d.select(F.col("global_idx").alias("qid"), F.col("image_id").alias("query_id"), F.col("local_idx").alias("query_idx"), "d")


def literal(vectors, images, k):
    """Votes as defined: every image among the survivors against the nearest of the others."""
    score = {}
    for i, v in enumerate(vectors):
        d = ((vectors - v) ** 2).sum(1)
        near = np.lexsort((np.arange(len(d)), d))[: k + 6]
        near = [j for j in near if images[j] != images[i]]
        for im in {images[j] for j in near}:
            own, other = [d[j] for j in near if images[j] == im], [d[j] for j in near if images[j] != im]
            if other and min(own) < min(other):
                key = images[i], im
                score[key] = score.get(key, 0) + min(other) - min(own)
    return score


@pytest.mark.parametrize("budget", [1 << 26, 0])
def test_votes_are_those_of_the_loop(spark, budget):
    rng = np.random.default_rng(3)
    v, im = rng.normal(size=(60, 8)), [f"i{k % 6}" for k in range(60)]
    v[7] = v[13]
    d = frame(spark, v, im)
    near = knn.nearest(queries(d).select("qid", "d"), d, 11, budget, 16)
    found = near.join(d.select("global_idx", "image_id", "local_idx"), "global_idx").join(queries(d).select("qid", "query_id", "query_idx"), "qid").where("image_id <> query_id")
    got = {(r.query_id, r.match_id): r.lnbnn_score for r in matching.scores(matching.votes(found)).collect()}
    want = literal(v, im, 5)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tie_votes_for_nobody(spark):
    d = frame(spark, np.array([[0.0, 0], [1, 0], [1, 0]]), ["q", "a", "b"])
    assert matching.votes(matching.survivors(queries(d).where("query_id = 'q'"), d)).count() == 0


def test_strategies_agree(spark):
    rng = np.random.default_rng(4)
    d = frame(spark, rng.normal(size=(50, 5)), ["x"] * 50)
    q = queries(d)
    key = lambda df: sorted((r.qid, r["rank"], r.global_idx) for r in df.collect())
    assert key(knn.nearest(q, d, 7)) == key(knn.nearest(q, d, 7, 0, 8)) == key(knn.nearest_sql(q, d, 7))
    most = 6.0
    pairs = {(i, j) for i, j in zip(*np.nonzero(((np.array(d.orderBy("global_idx").toPandas().d.tolist())[:, None] - np.array(d.orderBy("global_idx").toPandas().d.tolist())[None]) ** 2).sum(2) <= most), strict=True)}
    assert {(r.qid, r.global_idx) for r in knn.within(q, d, most).collect()} == pairs == {(r.qid, r.global_idx) for r in knn.within(q, d, most, 0, 8).collect()}


def test_equal_vectors_rank_by_index(spark):
    """200 equal vectors: neither the way nor the blocks choose among them."""
    d = frame(spark, np.concatenate([np.ones((200, 3)), np.zeros((5, 3))]), ["x"] * 205)
    q = queries(d).where("qid in (0, 150, 201)")
    key = lambda df: sorted((r.qid, r["rank"], r.global_idx) for r in df.collect())
    want = key(knn.nearest_sql(q, d, 5))
    assert [x for x in want if x[0] == 150] == [(150, i + 1, i) for i in range(5)]
    assert want == key(knn.nearest(q, d, 5)) == key(knn.nearest(q, d, 5, 0, 64)) == key(knn.nearest(q, d, 5, 0, 7))


def test_a_hot_cell_is_dealt_over_shares(spark, tmp_path):
    """Two thirds of the rows are near one point: dealt over shares or not, the rows found are the same, also without a summary."""
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.normal(size=(200, 4)) * 0.01, rng.normal(size=(100, 4)) * 20])
    d = frame(spark, v, ["x"] * len(v))
    q = queries(d).where("qid % 7 = 0")
    model = knn.cells(d, 6)
    shares = knn._shares(model, len(v), 16)
    assert shares.max() >= 12 and shares.min() >= 1
    key = lambda df: sorted((r.qid, r["rank"], r.global_idx) for r in df.collect())
    want = key(knn.nearest_by_cells(q, d, 5, model, 2))
    assert len(want) == 43 * 5 and len(set(want)) == len(want)
    assert want == key(knn.nearest_by_cells(q, d, 5, model, 2, cell_rows=16))
    assert key(knn.nearest_by_cells(q, d, 5, model, 6, cell_rows=16)) == key(knn.nearest(q, d, 5))
    assert knn.nearest_by_cells(q.limit(0), d, 5, model, 2, cell_rows=16).count() == 0
    model.save(str(tmp_path / "cells"))
    again = KMeansModel.load(str(tmp_path / "cells"))
    assert not again.hasSummary and want == key(knn.nearest_by_cells(q, d, 5, again, 2, cell_rows=16))


def test_ratio_test_is_that_of_the_loop(spark):
    """The two nearest of each image, with ties, broadcast and in blocks."""
    rng = np.random.default_rng(6)
    v, im = rng.integers(0, 3, size=(80, 3)).astype(float), [f"i{k % 5}" for k in range(80)]
    d = frame(spark, v, im)
    want = set()
    for i in range(80):
        for name in set(im) - {im[i]}:
            own = [j for j in range(80) if im[j] == name]
            own.sort(key=lambda j: (((v[j] - v[i]) ** 2).sum(), j))
            a, b = (float(np.sqrt(((v[j] - v[i]) ** 2).sum())) for j in own[:2])
            if a < b * 0.75:
                want.add((im[i], name, i // 5, own[0] // 5))
    for blocks in ({}, {"broadcast_bytes": 0, "block_rows": 16}):
        got = matching.ratio_matches(queries(d), d, **blocks).collect()
        assert {(r.query_id, r.match_id, r.query_idx, r.train_idx) for r in got} == want and len(got) == len(want) > 5
    plan = matching.ratio_matches(queries(d), d)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_projections_recall(spark):
    """Second sightings at most 0.5 apart, against all pairs."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 16))
    d = frame(spark, v, ["x"] * 300)
    again = frame(spark, v + rng.normal(size=v.shape) * 0.05, ["q"] * 300)
    exact = {(r.qid, r.global_idx) for r in knn.within(queries(again), d, 0.25).collect()}
    near = {(r.qid, r.global_idx) for r in knn.near_by_projections(queries(again), d, 0.5).collect()}
    assert near <= exact and len(near) >= 0.9 * len(exact) > 200


def test_cells_recall(spark):
    rng = np.random.default_rng(5)
    d = frame(spark, rng.normal(size=(200, 4)), ["x"] * 200)
    exact = {(r.qid, r.global_idx) for r in knn.nearest(queries(d), d, 5).collect()}
    near = {(r.qid, r.global_idx) for r in knn.nearest_by_cells(queries(d), d, 5, knn.cells(d, 8), 4).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_empty_database(spark):
    d = frame(spark, np.zeros((1, 2)), ["a"])
    assert knn.nearest(queries(d), d.where("false"), 3).count() == 0


def test_wrong_descriptors(spark):
    d = frame(spark, np.zeros((2, 3)), ["a", "b"])
    assert matching.check_descriptors(d) == 3
    for bad in (d.where("false"), d.union(frame(spark, np.zeros((1, 2)), ["c"])), d.withColumn("image_id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            matching.check_descriptors(bad)
    with pytest.raises(ValueError):
        matching.check_descriptors(d, 128)


@pytest.mark.parametrize("model,m", [("affine", [[0.9, -0.2, 12], [0.2, 0.9, -7]]), ("homography", [[0.9, -0.2, 12], [0.2, 0.9, -7], [1e-4, 2e-4, 1]])])
def test_transform_is_recovered(model, m):
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 200, (60, 2))
    b = apply(np.array(m), a)
    b[:18] += rng.uniform(50, 90, (18, 2))
    got, mask = ransac(a, b, model, seed=1)
    assert mask.sum() == 42 and not mask[:18].any()
    assert np.abs(apply(got, a[18:]) - b[18:]).max() < 1e-4
    assert np.array_equal(ransac(a, b, model, seed=1)[0], got)


@pytest.mark.parametrize("n,model", [(2, "affine"), (3, "homography"), (0, "affine")])
def test_too_few_points(n, model):
    assert ransac(np.zeros((n, 2)), np.zeros((n, 2)), model)[0] is None


def test_points_on_a_line():
    a = np.column_stack([np.arange(10.0), np.arange(10.0)])
    assert ransac(a, a, "affine", most=50)[0] is None


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        ransac(np.zeros((5, 2)), np.zeros((5, 2)), "spline")
    with pytest.raises(ValueError):
        verify.verify(spark.createDataFrame([], "query_id string, match_id string"), "spline")


def test_captions_round_by_the_exact_value(spark):
    """As Python's own formatting does, nulls included."""
    scores = [2.01185, 6.31975, 0.125, 1234.56785, 0.0]
    rows = [("a", "b", x, 2, 4, x / 2000) for x in scores]
    got = [r.caption for r in results.pair_text(spark.createDataFrame(rows, "query_id string, match_id string, score double, inliers long, total_matches long, inlier_ratio double")).collect()]
    assert got == [f"a vs b: score {x:.4f}, 2 of 4 inliers ({x / 2000 * 100:.1f}%)" for x in scores]
    (null,) = results.pair_text(spark.createDataFrame([("a", "b", None, 2, 4, None)], "query_id string, match_id string, score double, inliers long, total_matches long, inlier_ratio double")).collect()
    assert null.caption == "a vs b: score null, 2 of 4 inliers (null%)"


def test_copies_of_vectors_are_seen_where_the_first_one_is(spark, sf, tmp_path):
    """On a table repeated with shifted keys the search finds the first copy, and verification counts it as the planted rule does."""
    from markwise.plans.queries import hotspotter_ranked

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = e.count()
    e.unionByName(e.withColumn("vec_id", F.col("vec_id") + n)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = hotspotter_ranked(spark, str(tmp_path)).collect()
    assert len(got) == 10 and all(x.inliers == x.total_matches for x in got)


def test_projections_meet_in_blocks(spark, sf):
    """Whatever the blocks, each pair that shares a bucket comes once; no join makes a row per candidate."""
    from markwise.plans import surrogates

    d, q = surrogates.descriptors(spark, sf), surrogates.resight(spark, sf)
    rows = lambda df: sorted((r.qid, r.global_idx, round(r.distance, 9)) for r in df.collect())
    found = knn.near_by_projections(q, d, 0.9, block_rows=64)
    got = rows(found)
    assert got == rows(knn.near_by_projections(q, d, 0.9)) and len({r[:2] for r in got}) == len(got) >= 250


def test_cosines_meet_in_blocks(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(40, 6))
    x[3] = 0
    d = spark.createDataFrame([("a" if i < 25 else "b", i, v.tolist()) for i, v in enumerate(x)], "image_id string, global_idx long, d array<double>")
    for rows in (4, 2048):
        got = {(p.a, p.b): p.similarity for p in knn.cosines(d, "image_id", rows).collect()}
        assert set(got) == {(i, j) for j in range(40) for i in range(j) if (i < 25) == (j < 25)}
        for (i, j), c in got.items():
            assert abs(c - (0 if 3 in (i, j) else x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]))) < 1e-12


def test_queries_of_a_cell_meet_its_rows_in_blocks(spark, monkeypatch):
    """Many queries of a cell are dealt over tasks, and no join makes a row per candidate; the rows are the same."""
    r = np.random.default_rng(12)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 4)))], "global_idx long, d array<double>")
    q = d.withColumnRenamed("global_idx", "qid")
    model = knn.cells(d, 4)
    rows = lambda df: sorted((x.qid, x.global_idx, x.d2, x.rank) for x in df.collect())
    want = rows(knn.nearest_by_cells(q, d, 5, model, 2))
    monkeypatch.setattr(knn, "CELL_QUERIES", 10)
    found = knn.nearest_by_cells(q, d, 5, model, 2)
    assert rows(found) == want and "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_grow_with_the_tables(spark):
    """However small the blocks asked for, each side is copied SIDE times at most."""
    d = spark.range(400).selectExpr("id as global_idx", "array(cast(id as double), 1D) as d")
    found = knn.nearest(d.withColumnRenamed("global_idx", "qid"), d, 2, broadcast_bytes=0, block_rows=1)
    assert [knn._blocks(n, 512) for n in (0, 300, 2000, 600_000, 10_000_000)] == [1, 1, 4, 16, 153]
    assert {(r.qid, r.global_idx) for r in found.where("rank = 1").collect()} == {(i, i) for i in range(400)}


def test_blocks_of_distances_are_few_and_small():
    """Neighbours among copies, of large and of tiny labels, and how much memory a block of distances takes."""
    r = np.random.default_rng(5)
    d, q, ids = r.normal(size=(60_000, 8)), r.normal(size=(300, 8)), r.permutation(60_000)
    d[500:900] = q[0]
    for labels, k in ((ids % 7, 2), (ids % 5000, 2), (ids * 0, 11)):
        tracemalloc.start()
        row, found, d2 = knn._top_by_label(q, d, ids, labels, k)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(row) == 300 * k * len(set(labels.tolist())) and (most < 110e6 or labels.max() > 100)
        for i in (0, 1, 299):
            exact = ((q[i] - d) ** 2).sum(1)
            order = np.lexsort((ids, exact, labels))
            first = order[np.concatenate([[True] * k, labels[order][k:] != labels[order][:-k]])]
            assert sorted(found[row == i].tolist()) == sorted(ids[first].tolist())
    tracemalloc.start()
    row, found, d2 = knn._top(q, d, ids, 11)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6 and (found.reshape(300, 11)[0] == np.sort(ids[500:900])[:11]).all()


def test_copies_for_cosines_grow_no_faster_than_rows(spark):
    """Large labels are cut into few blocks, however small the blocks asked for."""
    r = np.random.default_rng(9)
    x = r.normal(size=(2000, 64)).astype(np.float32)
    d = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "image_id string, global_idx long, d array<float>")
    whole = knn.cosines(d, "image_id", 16).agg(F.count("*"), F.sum("similarity"))
    n, total = whole.collect()[0]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert n == 2000 * 1999 // 2 and abs(total - ((unit.sum(0) ** 2).sum() - 2000) / 2) < 1e-6

    def moved(plan) -> int:
        name, below = plan.getClass().getSimpleName(), plan.children()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            return moved(plan.executedPlan() if name[0] == "A" else plan.plan())
        own = plan.metrics().get("shuffleBytesWritten").get().value() if name == "ShuffleExchangeExec" else 0
        return own + sum(moved(below.apply(i)) for i in range(below.size()))

    assert 0 < moved(whole._jdf.queryExecution().executedPlan()) < 20 * x.nbytes
