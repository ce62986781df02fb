"""Every query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from markwise.plans.queries import ORACLE, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: repr(round(x, 6)) if isinstance(x, float) else repr(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    out = entry.entry(spark).toPandas()
    assert len(out) == 10 and all(q[2:] == m[4:] for q, m in zip(out.query_id, out.match_id, strict=True))


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
