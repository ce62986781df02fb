"""Scale calibration: tick spacing, fences against outliers, and the distribution of scales."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from markwise.functions.geometry import z_score


#: Rows up to which an exact quantile ranks all of them.
FEW = 10_000


def gaussian_smooth(signal: DataFrame, sigma: float = 2.0) -> DataFrame:
    """(series, t, v) smoothed; weights reach 4 sigma, values before the first and after the last are mirrored.

    Taps are explode-and-sum: each value goes to the places it reaches, so long series need no window frame in memory.
    """
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    taps = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(w / math.fsum(raw)).alias("w")) for i, w in zip(range(-reach, reach + 1), raw, strict=True)])
    ends = signal.groupBy("series").agg(F.min("t").alias("t0"), F.count("*").alias("n"))
    j = signal.join(ends, "series").withColumn("i", F.col("t") - F.col("t0"))
    placed = j.select("series", "t0", "n", "i", "v", F.explode(taps).alias("tap"))
    # Mirrored places have period 2n, and k and 2n - 1 - k hold the same value, however short the series is.
    period = 2 * F.col("n")
    want = placed.select("series", "t0", "n", "v", "tap.w", F.explode(F.array(F.pmod(F.col("i") - F.col("tap.o"), period), F.pmod(-1 - F.col("i") - F.col("tap.o"), period))).alias("k"))
    return want.where("k >= 0 and k < n").groupBy("series", (F.col("t0") + F.col("k")).alias("t")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def local_maxima(signal: DataFrame) -> DataFrame:
    """Values above both neighbours and at least the series' median."""
    own = W.Window.partitionBy("series").orderBy("t")
    middle = signal.groupBy("series").agg(F.percentile("v", 0.5).alias("median"))
    m = signal.withColumn("_a", F.lag("v").over(own)).withColumn("_b", F.lead("v").over(own)).join(middle, "series")
    return m.where((F.col("v") > F.col("_a")) & (F.col("v") > F.col("_b")) & (F.col("v") >= F.col("median"))).select("series", "t", "v")


def tick_spacing(ticks: DataFrame, least: float = 15, most: float = 150) -> DataFrame:
    """(series, n_ticks, spacing): the median distance of neighbouring ticks t, inside the quartile fences and the bounds.

    If the fences leave nothing all distances count; if the bounds leave nothing, or with under two ticks, it is 0.
    """
    own = W.Window.partitionBy("series").orderBy("t")
    d = ticks.withColumn("d", (F.col("t") - F.lag("t").over(own)).cast("double"))
    q = d.groupBy("series").agg(F.count("*").alias("n_ticks"), F.percentile("d", 0.25).alias("q1"), F.percentile("d", 0.75).alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    j = d.where("d is not null").join(q, "series").withColumn("ok", F.col("d").between(F.col("q1") - reach, F.col("q3") + reach))
    some = j.groupBy("series").agg(F.bool_or("ok").alias("some"))
    kept = j.join(some, "series").where((F.col("ok") | ~F.col("some")) & F.col("d").between(least, most))
    found = kept.groupBy("series").agg(F.percentile("d", 0.5).alias("spacing"))
    return q.select("series", "n_ticks").join(found, "series", "left").fillna({"spacing": 0.0})


def quantile(values: DataFrame, column: str, p: float) -> DataFrame:
    """One row, quantile: exact and interpolated, as percentile() has it; null for no values.

    An approximate quantile on either side leaves about a hundredth of the rows, of which one task ranks the distinct values;
    percentile() would bring all distinct values to it. Up to FEW rows all are ranked.
    """
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    near = F.percentile_approx("v", [max(0.0, p - 0.005), min(1.0, p + 0.005)], 10_000)
    ends = v.agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), near.alias("q"))
    few = F.col("n") <= FEW
    ends = ends.select((F.col("n") - 1).alias("last"), F.when(few, F.col("a")).otherwise(F.get("q", F.lit(0))).alias("a"), F.when(few, F.col("b")).otherwise(F.get("q", F.lit(1))).alias("b"))
    placed = v.crossJoin(F.broadcast(ends)).where(F.col("v") <= F.col("b"))
    inside = F.when(F.col("v") >= F.col("a"), F.col("v"))  # all that lie below share one group
    counted = placed.groupBy(inside.alias("v")).agg(F.count("*").alias("n"), F.first("last").alias("last"))
    after = counted.withColumn("after", F.sum("n").over(W.Window.orderBy(F.asc_nulls_first("v"))))
    rank = F.col("last") * p
    at = lambda r: F.max(F.when((F.col("after") > r) & (F.col("after") - F.col("n") <= r), F.col("v")))
    found = after.agg(at(F.floor(rank)).alias("low"), at(F.ceil(rank)).alias("high"), F.first(rank - F.floor(rank)).alias("part"))
    return found.select((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"))


def scale_stats(metrics: DataFrame, value: str = "ppm") -> DataFrame:
    """One row: mean, median, std, min, max and count of the positive scales; zeros for none."""
    v = F.when(F.col(value) > 0, F.col(value))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rest = metrics.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"))
    both = rest.crossJoin(F.broadcast(quantile(metrics.select(v.alias("v")), "v", 0.5)))  # one row each
    return both.select(zero(F.col("mean")).alias("mean"), zero(F.col("quantile")).alias("median"), zero(F.col("std")).alias("std"), zero(F.col("min")).alias("min"), zero(F.col("max")).alias("max"), "count")


def scale_outliers(metrics: DataFrame, value: str = "ppm", threshold: float = 2.0) -> DataFrame:
    """Rows whose positive scale is more than threshold deviations from the mean; statistics are one row, so broadcast."""
    v = F.when(F.col(value) > 0, F.col(value))
    stats = metrics.agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    z = z_score(F.col(value), F.col("_m"), F.col("_s"))
    return metrics.where(F.col(value) > 0).crossJoin(F.broadcast(stats)).withColumn("z", z).where(F.col("z") > threshold).drop("_m", "_s")


def scale_histogram(metrics: DataFrame, value: str = "ppm", bins: int = 30) -> DataFrame:
    """(bin, n) of the positive scales in equal bins from the least to the largest, both included."""
    v = F.when(F.col(value) > 0, F.col(value))
    ends = metrics.agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    place = F.least(F.lit(bins), F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins).cast("int") + 1)
    j = metrics.where(F.col(value) > 0).crossJoin(F.broadcast(ends))
    return j.groupBy(F.when(F.col("_b") > F.col("_a"), place).otherwise(F.lit(1)).alias("bin")).agg(F.count("*").alias("n"))


def scale_box(metrics: DataFrame, value: str = "ppm") -> DataFrame:
    """One row of the positive scales' box plot: quartiles, whiskers (the last values within 1.5 quartile distances) and count of fliers."""
    v = metrics.where(F.col(value) > 0).select(F.col(value).alias("v"))
    one = lambda p, name: F.broadcast(quantile(v, "v", p).withColumnRenamed("quantile", name))
    box = one(0.25, "q1").crossJoin(one(0.5, "median")).crossJoin(one(0.75, "q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    ends = v.crossJoin(F.broadcast(box)).agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("fliers"))
    return box.crossJoin(F.broadcast(ends)).where("median is not null")


def error_class(metrics: DataFrame) -> DataFrame:
    """extraction_error of (ruler_pixels, same_shape, roi_pixels, ppm): the first that holds, else null."""
    return metrics.withColumn("extraction_error", F.when(F.col("ruler_pixels") == 0, "no_ruler_detected").when(~F.col("same_shape"), "dimension_mismatch").when(F.col("roi_pixels") == 0, "roi_extraction_failed").when(F.col("ppm") == 0, "no_ticks_detected"))
