"""A training-data pipeline: STAGES, each from documents to documents, and run() over all of them.

toxicity        documents that score 0.5 or more go
line_dedup      lines whose key is in ten documents or more go
near_dedup      of each component of near duplicates (five words, 0.8) the one row of smallest (doc_id, text, other columns) stays
mixing          sources are replicated to equal weights and shuffled
sentencepiece   the last stage: documents with piece ids, and whether they decode to the text

In all stages: rows are judged one by one whatever keys they repeat, except that near_dedup keeps one row of each component; texts are whole, however
long; an empty table gives an empty one; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.llm.common import fresh, quoted, stored, table
from markwise.llm.lines import drop_lines
from markwise.llm.mixing import mix
from markwise.llm.neardup import near_duplicates
from markwise.llm.queries import PIECE_BPE, vocabulary
from markwise.llm.sentencepiece import encode
from markwise.llm.toxicity import train, with_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of sf_dir; a null text scores like an empty one, repeated rows alike. Very long texts are hashed in blocks."""
    machine = train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "_score")
    return with_scores(docs, machine, score=score).where(F.col(score) < 0.5).select(*quoted(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text; a document that loses all lines stays with an empty text, a null text stays null.

    Repeated rows count each as a document of a line, and lose the same lines.
    """
    n_lines, n_dropped = fresh(docs, "_n_lines", "_n_dropped")
    kept = drop_lines(docs, n_lines=n_lines, n_dropped=n_dropped)
    n_chars = F.when(F.col(n_dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*quoted(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged one by one, whatever doc_ids they repeat; a null doc_id is larger than any other, a text without words stays.

    Until a doc_id repeats inside a component, rows are known by a 64-bit hash of doc_id and text: two of n rows share one
    with probability n^2 / 2^65.
    """
    row, component, smallest = fresh(docs, "_row", "_component", "_least")
    own = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = near_duplicates(own.select(row, "text"), key=row).where("n_shingles > 0")
    verdict = stored(found.select(row, F.col("component_id").alias(component)).distinct(), "near-verdict")
    ids = own.select(row, "doc_id").join(verdict, row).groupBy(component, "doc_id").agg(F.count("*").alias("n"), F.min(row).alias(row))
    least = ids.groupBy(component).agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "n", row)).alias("least"))
    least = stored(least.select(component, F.col("least.doc_id").alias(smallest), "least.n", F.col("least")[row].alias(row)), "near-least")
    gone = verdict.join(least.where("n = 1"), row, "left_anti").select(row)
    alone = own.join(gone, row, "left_anti").select(*quoted(docs))
    tied = verdict.join(least.where("n > 1").select(component, smallest), component)
    order = ["doc_id", "text", *[c for c in quoted(docs.drop("doc_id", "text"))]]
    same = own.join(tied, row).where(F.col("doc_id").eqNullSafe(F.col(smallest)))
    rows = same.groupBy(component).agg(F.min(F.struct(*order)).alias("first")).select("first")
    return alone.unionByName(rows.select(*[F.col("first").getField(c).alias(c) for c in docs.columns]))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without weights: every source gets the same share, a null source too. A row's copies depend on its doc_id (without one: its text), so repeated
    rows get as many each; a null or very long text travels as it is."""
    return mix(docs).select(*quoted(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, piece_ids, and whether they decode to the text. A null text has no ids; repeated rows have equal ones."""
    return encode(docs, vocabulary(PIECE_BPE), check="round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: A learnt score is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
