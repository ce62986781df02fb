"""The stages' order and effects, on a small table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from markwise.llm.common import table

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def sf():
    """With enough labels to learn from."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf).cache()
        out.append((name, docs, got))
        docs = got
    return out


def test_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    assert all(d.columns == COLUMNS for _, _, d in stages[:-1]) and set(COLUMNS) < set(stages[-1][2].columns)


def test_each_stage(stages, spark, sf):
    (_, all_docs, clean), (_, _, lined), (_, _, alone), (_, _, mixed), (_, _, coded) = stages
    assert 0 < clean.count() < all_docs.count()
    toxic = table(spark, sf, "labels").where("toxic = 1").join(clean, "doc_id").count()
    assert toxic <= 0.3 * table(spark, sf, "labels").where("toxic = 1").count()
    assert lined.count() == clean.count()
    assert 0.7 * lined.count() < alone.count() <= lined.count()
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in alone.collect()}
    assert coded.count() == mixed.count() and coded.where("not round_trip").count() == 0


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1][2].count()
    assert corpus_pipeline.ORACLE_SQL is None


ROWS = [(0, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", None, 0), (3, "x" * 2000, "en", "s", None), (3, "x" * 2000, "en", "s", None), (5, "word " * 3000, None, "t", 1), (6, "A\nb\nA", "en", "s", 5)]
CLASHING = ("score", "_score", "n_lines", "n_dropped", "copy", "n_copies", "mix_key", "chunk", "key", "node", "fp", "root", "piece_ids", "removed", "n_words", "kept", "component_id", "_row", "_component", "_least", "_id", "_source", "_parts", "_key", "_text", "_cut", "_n_lines", "first")


def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows_and_empty_tables(spark, sf, name, stage):
    """Nulls in any column, empty and long texts, repeated rows; no row is lost but by the stage's own decision."""
    docs = odd(spark)
    got = stage(spark, docs, sf)
    assert set(COLUMNS) <= set(got.columns)
    n = got.count()
    assert n == {"mixing": n, "near_dedup": len(ROWS) - 1}.get(name, len(ROWS))  # two equal rows are a group of near duplicates
    assert stage(spark, docs.where("false"), sf).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_clashing_columns(spark, sf, name, stage):
    docs = odd(spark).select("*", *[F.lit("mine").alias(c) for c in CLASHING])
    got = stage(spark, docs, sf)
    got.collect()
    assert set(COLUMNS) <= set(got.columns) and "lang" in got.columns
    kept = [c for c in CLASHING if c in got.columns and dict(got.dtypes)[c] == "string"]
    assert {"root", "node", "fp", "key", "chunk"} <= set(kept)
    assert all(r[c] == "mine" for r in got.select(*kept).collect() for c in kept)


def test_near_dedup_judges_rows(spark, sf):
    """One row of each component stays, also where doc_ids repeat or are null; texts without words all stay."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "r", 1), (1, b, "en", "s", 1), (2, b + " more", "en", "s", 1), (2, c, "en", "s", 1), (None, a + " more", "en", "s", 1), (None, "null " * 9, "en", "s", 1), (None, "null " * 9, "en", "r", 1), (4, b + " and", "en", "s", 1), (4, a + " and", "en", "s", 1), (7, None, "en", "s", 1), (7, "", "en", "s", 1), (7, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, sf).collect()), key=repr)
    assert got == sorted([(1, a, "en", "r", 1), (1, b, "en", "s", 1), (2, c, "en", "s", 1), (None, "null " * 9, "en", "r", 1), (7, None, "en", "s", 1), (7, "", "en", "s", 1), (7, "", "en", "s", 1)], key=repr)


def test_near_dedup_with_a_repeated_key(spark, sf):
    """A key of all rows leaves as many documents as keys of their own."""
    docs = table(spark, sf, "documents").select(*COLUMNS).limit(300).cache()
    texts = lambda d: sorted(r.text or "" for r in d.collect())
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    n = kept.count()
    assert n < docs.count()
    for key in ("7", "null"):
        assert len(texts(corpus_pipeline.near_dedup(spark, docs.withColumn("doc_id", F.expr(f"cast({key} as long)")), sf))) == n
