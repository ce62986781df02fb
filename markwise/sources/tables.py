"""Metrics, results and renames as JSON, CSV and Parquet; what is replaced in place is there, old or new, whenever a write dies (recovered())."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.operators.progress import latest
from markwise.operators.results import RESULTS, nest

MATCHES = "query_id string, query_side string, match_id string, match_side string, score double, inliers long, total_matches long, inlier_ratio double, lnbnn_score double"
METRICS = "image string, metrics struct<pixels_per_mm: double, fish_length_px: double, fish_length_mm: double, ruler_bbox: array<int>, length_method: string, ruler_detected: boolean, extraction_error: string>"


def write_results(matches: DataFrame, path: str) -> None:
    """One JSON document per query: {query: [match, ...]}, best first."""
    nest(matches).select(F.to_json(F.create_map("query_id", "matches")).alias("value")).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(query_id, matches) from documents per line, or (whole) from one document per file."""
    text = spark.read.text(path, wholetext=whole)
    return text.select(F.explode(F.from_json("value", RESULTS)).alias("query_id", "matches"))


def write_csv(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCHES).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _beside(spark: SparkSession, path: str) -> tuple:
    """The file system, the path, and where its next and its last contents lie while it is replaced."""
    jvm = spark._jvm
    place, new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{end}") for end in ("", ".new", ".old"))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place, new, old


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether there is something at the path, after a replacement that died halfway is finished: the new contents if they are whole, else the old ones."""
    fs, place, new, old = _beside(spark, path)
    if not fs.exists(place):
        whole = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(new, "_SUCCESS"))
        if whole or fs.exists(old):
            fs.rename(new if whole else old, place)
    if fs.exists(place) and fs.exists(old):
        fs.delete(old, True)
    return fs.exists(place)


def replace_json(df: DataFrame, path: str) -> None:
    """Writes beside the path, which df may read, moves the old contents away and the new ones in. Whenever it dies, recovered() finds one of them whole."""
    spark = df.sparkSession
    fs, place, new, old = _beside(spark, path)
    df.write.mode("overwrite").json(new.toString())
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(new, place)
    fs.delete(old, True)


def read_metrics(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(image_id, metrics.*) by file stem; whole: one list per file. Of repeated images the last counts, files in order of their names."""
    rows = spark.read.schema(METRICS).json(path, multiLine=whole).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    named = rows.withColumn("image_id", F.regexp_extract("image", r"([^/]+?)(\.[^./]*)?$", 1))
    return latest(named, "image_id", "_at").select("image_id", "metrics.*")


def write_features(features: DataFrame, path: str) -> None:
    """Key points without descriptors read as fast as ever: columns are pruned."""
    features.write.mode("overwrite").parquet(path)


def read_keypoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("local_idx is not null").drop("d", "error")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, in the one that the cluster names in spark.checkpoint.dir; a temporary one only in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="markwise-scratch-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
