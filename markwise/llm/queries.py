"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .counts import token_counts
from .lines import LINES_SQL, drop_lines
from .matroska import PACKETS_SQL, PAYLOAD_SQL, media_digests, media_files, packet_table
from .mixing import MIX_SQL, mix
from .neardup import near_duplicates
from .periods import RUNS_SQL, run_digests
from .pii import PII_COUNTS_SQL, find_pii
from .quality import quality, quality_sql
from .sentencepiece import piece_digests
from .substrings import REPEATS_SQL, remove_repeats
from .tokens import token_digests
from .toxicity import toxicity
from .variants import VARIANTS_SQL, count_words, variant_groups

#: The vocabulary file and end id of op5.
WORD_BPE = "word_bpe_49k.json"
END_ID = 2
#: The model of op10 and op11.
PIECE_BPE = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), END_ID)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids (as little-endian 32-bit integers) and of the decoded text, of each whole text."""
    path = vocabulary(PIECE_BPE)
    return piece_digests(table(spark, sf_dir, "documents"), path)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(PIECE_BPE))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(table(spark, sf_dir, "documents"), typos=31).where("n >= 2")
    return variant_groups(words, ratio=10)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def media_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of all texts' files, without what only the writer's bytes tell."""
    files = media_files(table(spark, sf_dir, "documents"))
    return packet_table(files).select("doc_id", "packet", "track", "timestamp_ns", "duration_ns", "byte_size", "cluster", "block", "keyframe")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {f.__name__: f for f in (media_payload, media_packets, pii_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": MIX_SQL, "op4_line_dedup": LINES_SQL, "op6_substring_dedup": REPEATS_SQL, "op7_quality_rules": quality_sql(), "media_payload": PAYLOAD_SQL, "media_packets": PACKETS_SQL, "pii_counts": PII_COUNTS_SQL, "op12_spelling_variants": VARIANTS_SQL, "op13_periodic_runs": RUNS_SQL}
