"""What is left to do: progress by image, required steps, the work queue, and upserts of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def progress(images: DataFrame, artifacts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(image_id, segmentation, metrics, standardization, qa_plots) by equality of names.

    artifacts: (image_id, kind), with kinds fish, whole_fish, ruler, image, mask, qa_ticks, qa_standardized;
    metrics: (image_id, pixels_per_mm).
    """
    has = lambda k: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False))
    done = artifacts.groupBy("image_id").agg(
        ((has("fish") | has("whole_fish")) & has("ruler")).alias("segmentation"), (has("image") & has("mask")).alias("standardization"), (has("qa_ticks") | has("qa_standardized")).alias("qa_plots")
    )
    measured = metrics.groupBy("image_id").agg(F.bool_or(F.col("pixels_per_mm") > 0).alias("metrics"))
    j = images.select("image_id").distinct().join(done, "image_id", "left").join(measured, "image_id", "left")
    return j.select("image_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("segmentation", "metrics", "standardization", "qa_plots")])


def required_steps(table: DataFrame, extract: bool = True, standardize: bool = True, force: bool = False) -> DataFrame:
    """need_segmentation, need_metrics and need_standardization; metrics run again after a new segmentation."""
    seg, met, std = ~F.col("segmentation"), ~F.col("metrics"), ~F.col("standardization")
    e, s, f = F.lit(extract), F.lit(standardize), F.lit(force)
    return table.select(
        "*",
        (f | (e & seg) | (s & std & seg)).alias("need_segmentation"),
        F.when(f, e).otherwise(e & (seg | met)).alias("need_metrics"),
        F.when(f, s).otherwise(s & std).alias("need_standardization"),
    )


def work_queue(steps: DataFrame) -> DataFrame:
    return steps.where("need_segmentation or need_metrics or need_standardization")


def step_summary(steps: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    left = (F.col("need_segmentation") | F.col("need_metrics") | F.col("need_standardization")).cast("long")
    return steps.agg(F.count("*").alias("n_images"), n("need_segmentation"), n("need_metrics"), n("need_standardization"), F.coalesce(F.sum(left), F.lit(0)).alias("n_work"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    own = W.Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and those of old whose key is not in it."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def rename_plan(images: DataFrame, heads: DataFrame, prefix: str = "JAVR") -> DataFrame:
    """(old_name, new_name, head_direction, status) of images of the prefix that name no side; a taken name is a failure.

    heads: (image_id, head_left); an unknown direction is a failure too.
    """
    todo = images.where(~F.upper("image_id").rlike("[LR]$") & F.upper("image_id").startswith(prefix))
    j = todo.join(heads, "image_id", "left").withColumn("head_direction", F.when(F.col("head_left"), "L").when(~F.col("head_left"), "R"))
    j = j.withColumn("_new", F.concat("image_id", "head_direction"))
    taken = images.select(F.col("image_id").alias("_new"), F.lit(True).alias("_taken")).distinct()
    j = j.join(taken, "_new", "left")
    return j.select(F.col("image_id").alias("old_name"), F.concat("_new", F.lit(".jpg")).alias("new_name"), "head_direction", F.when(F.col("_new").isNull() | F.col("_taken"), "failed").otherwise("ok").alias("status"))
