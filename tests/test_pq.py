"""The stored index: recall, growth without a refit, buckets that aren't shuffled, batches that died."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwise.operators import knn, pq
from markwise.plans import surrogates
from markwise.plans.matching import one_vs_many, stored_index
from markwise.sources.settings import Matching


def frame(spark, x, per_image=20, first=0):
    rows = [(f"im{first + i // per_image:04}", i % per_image, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "image_id string, local_idx long, d array<float>")


def as_queries(x, spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, d array<float>")


def clustered(n, dim=32, groups=40, seed=1, spread=0.3):
    r = np.random.default_rng(seed)
    return (np.random.default_rng(7).normal(size=(groups, dim))[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))).astype(np.float32)


def named(found):
    return {(r.qid, r.image_id, r.local_idx, r.rank) for r in found.collect()}


def exact(x, q, k):
    out = set()
    for i, v in enumerate(q.astype(np.float64)):
        d = ((x - v) ** 2).sum(1)
        out |= {(i, f"im{j // 20:04}", int(j % 20)) for j in np.lexsort((np.arange(len(x)), d))[:k]}
    return out


def recall(found, x, q, k):
    return len({r[:3] for r in named(found)} & exact(x, q, k)) / (k * len(q))


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pq") / "index")
    x = clustered(1200)
    first = frame(spark, x[:1000])
    index = pq.Index.create(first.withColumn("global_idx", F.monotonically_increasing_id()), path, subspaces=8, n_cells=24)
    assert index.add(first) == 1000
    return path, x, index


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_recall_and_bytes(spark, grown):
    _, x, index = grown
    q = clustered(60, seed=9)
    assert recall(index.search(as_queries(q, spark), 11, probes=8), x[:1000], q, 11) >= 0.9
    assert recall(index.search(as_queries(q, spark), 11, probes=24, refine=91), x[:1000], q, 11) == 1
    assert index.bytes_per_descriptor() == 16  # 8 of the id, 8 of the code, against 128 of the vector


def test_recall_on_unstructured_vectors(spark, sf):
    d = surrogates.descriptors(spark, sf)
    near = {(r.qid, r.global_idx) for r in knn.nearest(surrogates.as_queries(d), d, 11).collect()}
    from markwise.plans.queries import pq_knn

    got = {(r.qid, r.global_idx) for r in pq_knn(spark, sf).collect()}
    assert len(near & got) / len(near) >= 0.9


def test_growth_is_a_rebuild(spark, grown, tmp_path):
    path, x, _ = grown
    before = files(path)
    index = pq.Index(spark, path)  # as another session would
    assert index.add(frame(spark, x[:1000])) == 0
    assert index.add(frame(spark, x)) == 200
    after = files(path)
    assert before.items() <= after.items()
    q = as_queries(clustered(40, seed=11), spark)
    rebuilt = pq.Index.create(frame(spark, x[:1000]).withColumn("global_idx", F.monotonically_increasing_id()), str(tmp_path / "again"), subspaces=8, n_cells=24)
    assert rebuilt.add(frame(spark, x)) == 1200
    assert named(index.search(q, 11, probes=6)) == named(rebuilt.search(q, 11, probes=6))
    assert recall(index.search(q, 11, probes=24, refine=110), x, clustered(40, seed=11), 11) == 1


def test_the_database_side_is_not_shuffled(spark, grown):
    _, _, index = grown
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.search(as_queries(clustered(5), spark), 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for table in ("codes", "vectors"):
        lines = plan.split("\n")
        at = next(i for i, line in enumerate(lines) if re.search(rf"FileScan parquet \S*pq_\w+_{table}", line))
        assert "Bucketed: true" in lines[at]
        depth = re.search(r"\+- |:- ", lines[at]).start()
        for line in reversed(lines[:at]):  # the scan's ancestors, up to the join
            m = re.search(r"\+- |:- ", line)
            if m and m.start() < depth:
                depth = m.start()
                if "SortMergeJoin" in line:
                    break
                assert "Exchange" not in line
        else:
            raise AssertionError("no join above the scan")


def test_a_batch_that_died_is_nothing(spark, grown, tmp_path, monkeypatch):
    x = clustered(300, seed=3)
    index = pq.Index.create(frame(spark, x).withColumn("global_idx", F.monotonically_increasing_id()), str(tmp_path / "ix"), subspaces=4, n_cells=4)
    index.add(frame(spark, x[:100]))
    q = as_queries(x[:20], spark)
    before = named(index.search(q, 5, probes=4))

    def die(*a, **b):
        raise RuntimeError("lost")

    more = frame(spark, x)
    with monkeypatch.context() as m:  # the last step, after codes and vectors are written
        m.setattr(type(spark), "createDataFrame", die)
        with pytest.raises(RuntimeError):
            index.add(more)
    assert index.rows() == 100 and named(index.search(q, 5, probes=4)) == before
    assert index.add(frame(spark, x)) == 200
    assert recall(index.search(q, 5, probes=4, refine=60), x, x[:20], 5) == 1


def test_a_hot_cell_is_dealt_over_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pq, "SHARE_ROWS", 50)
    x = np.concatenate([clustered(100, seed=5), np.repeat(clustered(1, seed=6), 300, axis=0)])
    d = frame(spark, x)
    index = pq.Index.create(d.withColumn("global_idx", F.monotonically_increasing_id()), str(tmp_path / "hot"), subspaces=8, n_cells=6)
    index.add(d)
    parts = index.codes().groupBy("cell").agg(F.countDistinct("share").alias("shares"), F.sum("n").alias("n")).collect()
    assert max(p.shares for p in parts if p.n >= 300) >= 6
    got = named(index.search(as_queries(x[-1:], spark), 7, probes=6))
    assert {r[1:3] for r in got} == {(f"im{j // 20:04}", j % 20) for j in range(100, 107)}  # equal vectors rank by index


def test_matching_by_the_index_is_the_exact_one(spark, tmp_path):
    r = np.random.default_rng(2)
    base, rows = r.normal(size=(4, 30, 16)), []
    points = r.uniform(0, 200, size=(4, 30, 2))
    for animal in range(4):
        for sight in range(2):
            for i in range(30):
                v = base[animal, i] + 0.02 * r.normal(size=16)
                px, py = points[animal, i] + sight * np.array([10, 5])
                rows.append((f"a{animal}_{sight}", i, float(px), float(py), v.tolist()))
    features = spark.createDataFrame(rows, "image_id string, local_idx long, x double, y double, d array<float>")
    some = features.where("image_id <> 'a0_0'")
    settings = Matching(use_pq=True, probes=6, refine=8)
    index = stored_index(some, str(tmp_path / "ix"))
    trained = files(str(tmp_path / "ix"))
    index = stored_index(features, str(tmp_path / "ix"))
    assert trained.items() <= files(str(tmp_path / "ix")).items() and index.rows() == 240
    best = lambda df: {(m.query_id, m.match_id, m.inliers) for m in df.where("rank = 1").collect()}
    found = best(one_vs_many(features, None, settings, index))
    assert found == best(one_vs_many(features, None, settings)) and len(found) == 8
    few = features.where("image_id <> 'a1_1'")
    assert all(m.match_id != "a1_1" for m in one_vs_many(few, None, settings, index).collect())


def test_wrong_input(spark, tmp_path):
    bad = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "global_idx long, d array<float>")
    for d in (bad, bad.limit(0), bad.union(spark.createDataFrame([(2, [1.0])], bad.schema))):
        with pytest.raises(ValueError):
            pq.train(d, subspaces=2)


def test_fewer_points_than_codes():
    assert len(pq.lloyd(np.array([[1.0], [1.0], [2.0]]), 5)) == 2
    x = np.concatenate([np.zeros((50, 2)), np.ones((50, 2)), np.full((3, 2), 9.0)])
    assert sorted(map(tuple, pq.lloyd(x + np.arange(103)[:, None] * 1e-9, 3, rounds=40).round().tolist())) == [(0, 0), (1, 1), (9, 9)]


def test_candidates_that_codes_cannot_narrow_meet_in_blocks(spark, grown):
    """With every row a candidate, no row per query and row of the index is shuffled, and the rows are the exact ones."""
    _, x, index = grown
    q = clustered(60, seed=9)
    found = index.search(as_queries(q, spark), 5, probes=24, refine=index.rows())
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    own = exact(x[: index.rows()], q, 5)
    assert {r[:3] for r in named(found)} == own


def test_many_queries_come_in_turns(spark, grown, monkeypatch):
    """A cell's queries are dealt over tasks, and the rows are those of one turn."""
    _, x, index = grown
    q = as_queries(x[:300], spark)
    once = sorted(map(tuple, index.search(q, 5, 4, 4).collect()))
    monkeypatch.setattr(pq, "TURN_QUERIES", 100)
    monkeypatch.setattr(pq, "PACKED", 50)
    found = index.search(q, 5, 4, 4)
    plan = found._jdf.queryExecution().toString()
    assert "turn" in plan
    assert sorted(map(tuple, found.collect())) == once
