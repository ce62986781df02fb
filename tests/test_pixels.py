"""Set operations of masks."""

import pytest
from pyspark.sql import functions as F

from markwise.operators import pixels as px
from markwise.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["mask_union", "mask_intersect", "mask_except", "background_fill"])
def test_tasks_grow_with_the_table(spark, sf, monkeypatch, name):
    """what a task holds is set by the rows, not by the session's number of partitions."""
    monkeypatch.setattr(px, "TASK_ROWS", 500, raising=False)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    sizes = [n for _, n in QUERIES[name](spark, sf).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == -(-lines // 500) and max(sizes) < 2 * 500


def test_sets_of_pixels(spark):
    """Repeated rows count once, nulls are alike, and dealing changes nothing."""
    a, b = [(1, 0, 0), (1, 0, 0), (None, 1, 1), (2, 3, None), (5, 5, 5)], [(1, 0, 0), (None, 1, 1), (2, 3, 4), (2, 3, 4)]
    tables = [spark.createDataFrame(t, "image_id long, x int, y int") for t in (a, b)]
    for left, right in (tables, [px.dealt(t) for t in tables], [px.dealt(t, 10**7) for t in tables]):
        found = [[tuple(r) for r in f(left, right).collect()] for f in (px.union, px.intersect)]
        assert all(len(x) == len(set(x)) for x in found)
        assert [set(x) for x in found] == [set(a) | set(b), set(a) & set(b)]
        assert px.intersect(left, right).columns == ["image_id", "x", "y"]
        assert px.intersect(left, right.limit(0)).count() == 0 and px.union(left.limit(0), right.limit(0)).count() == 0
