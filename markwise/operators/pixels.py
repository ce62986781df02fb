"""Masks as a table pixels(image_id, x, y[, v]): geometry and profiles as grouped aggregates.

Every operator groups by image first, with map-side partial aggregates, so one exchange of a few numbers per image (or
per image and column) is all that moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from markwise.functions.geometry import half_turn

#: How many rows dealt() gives a task: some 120 bytes each in every hash table of the task.
TASK_ROWS = 500_000


def moments(pixels: DataFrame) -> DataFrame:
    """Area, centroid, bounding box and its center, and the principal axis, in one aggregation.

    The axis is both the moments' angle and the first principal component's. Masks are counted inclusive of x_max, y_max.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    spread_x, spread_y, shared = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    axis = F.when(spread_y == 0, F.lit(0.0)).otherwise(half_turn(F.degrees(F.atan2(shared * 2, spread_x - spread_y) * 0.5)))
    return pixels.groupBy("image_id").agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        ((F.min("x") + F.max("x")) / 2).alias("box_x"), ((F.min("y") + F.max("y")) / 2).alias("box_y"), axis.alias("angle"),
    )


def dealt(pixels: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows by whole pixels over tasks of about TASK_ROWS each, whatever number of partitions the session has set; rows: how many there are, counted if not given.

    What groups or joins by pixels after it, and the union of tables dealt alike, moves nothing more.
    """
    n = pixels.count() if rows is None else rows
    return pixels.repartition(max(pixels.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), "image_id", "x", "y")


def with_empty(images: DataFrame, found: DataFrame) -> DataFrame:
    """Images without a pixel have area 0 and centroid and box center (0, 0)."""
    zero = {c: 0 for c in ("area", "cx", "cy", "box_x", "box_y") if c in found.columns}
    return images.select("image_id").distinct().join(found, "image_id", "left").fillna(zero)


def profile(pixels: DataFrame, axis: str) -> DataFrame:
    """(image_id, axis, n): pixels of every column (axis x) or row (axis y) between the first and last one, zeros included."""
    counts = pixels.groupBy("image_id", axis).agg(F.count("*").alias("n"))
    ends = counts.groupBy("image_id").agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))
    dense = ends.select("image_id", F.explode(F.sequence("_a", "_b")).alias(axis))
    return dense.join(counts, ["image_id", axis], "left").fillna({"n": 0})


def edge_profile(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))


def _placed(table: DataFrame, axis: str) -> DataFrame:
    """rn, from 1, and the length of each image's profile."""
    own = W.Window.partitionBy("image_id")
    return table.withColumn("rn", F.row_number().over(own.orderBy(axis))).withColumn("len", F.count("*").over(own))


def _deviation(values: Column) -> Column:
    """The population deviation of an array, summed up in its order: equal arrays, and those that SQL reads in this order, compare alike whatever the partitions. Null if empty."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, v: Column) -> Column:
        mean = s["mean"] + (v - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["squares"] + (v - mean) * (v - s["mean"])).alias("squares"))

    return F.aggregate(values, start, step, lambda s: F.sqrt(F.try_divide(s["squares"], s["n"])))


def _in_order(place: Column | str, value: Column | str) -> Column:
    """A group's values in order of their places, as an array of (place, value)."""
    at = lambda c: F.col(c) if isinstance(c, str) else c
    return F.sort_array(F.collect_list(F.struct(at(place).alias("at"), at(value).cast("double").alias("v"))))


def half_profile_stats(pixels: DataFrame, axis: str) -> DataFrame:
    """Means and population deviations of the profile's halves, cut at half its length rounded down."""
    p = _placed(profile(pixels, axis), axis).withColumn("first", F.col("rn") <= F.floor(F.col("len") / 2))
    of = lambda f, side: F.coalesce(f(F.when(F.col("first") == side, F.col("n").cast("double"))), F.lit(0.0))
    stats = p.groupBy("image_id").agg(
        of(F.avg, True).alias("mean_first"), of(F.avg, False).alias("mean_second"), _in_order("rn", "n").alias("_own"),
        F.max("len").alias("len"), F.min_by("rn", F.struct(-F.col("n"), F.col("rn"))).alias("widest"),
    )
    half = lambda first: F.transform(F.filter("_own", lambda x: (x["at"] <= F.floor(F.col("len") / 2)) == first), lambda x: x["v"])
    spread = lambda first: F.coalesce(_deviation(half(first)), F.lit(0.0))
    return stats.select("image_id", "mean_first", "mean_second", spread(True).alias("std_first"), spread(False).alias("std_second"), "len", "widest")


def edge_roughness(pixels: DataFrame) -> DataFrame:
    """Population deviations of the edges, summed up from column to column."""
    rows = edge_profile(pixels).groupBy("image_id").agg(_in_order("x", "top").alias("top"), _in_order("x", "bottom").alias("bottom"))
    values = lambda c: F.transform(c, lambda x: x["v"])
    return rows.select("image_id", _deviation(values("top")).alias("top_roughness"), _deviation(values("bottom")).alias("bottom_roughness"))


def convexity(pixels: DataFrame) -> DataFrame:
    """Mean second differences of the edges, as (last - first first-difference) / (columns - 2); 0 for under three columns."""
    own = W.Window.partitionBy("image_id").orderBy("x")
    d = _placed(edge_profile(pixels), "x")
    for c in ("top", "bottom"):
        d = d.withColumn(f"_{c}", F.col(c) - F.lag(c).over(own))

    def bend(c: str) -> Column:
        first, last = F.max(F.when(F.col("rn") == 2, F.col(c))), F.max(F.when(F.col("rn") == F.col("len"), F.col(c)))
        return F.when(F.max("len") > 2, (last - first) / (F.max("len") - 2)).otherwise(F.lit(0.0))

    return d.groupBy("image_id").agg((-bend("_top")).alias("convexity_top"), bend("_bottom").alias("convexity_bottom"))


def tips(pixels: DataFrame, flare: float = 1.2) -> DataFrame:
    """Means of the outer tenth of the column profile and of the tenth next to it, on both sides, and where the tip flares."""
    p = _placed(profile(pixels, "x"), "x").withColumn("k", F.greatest(F.lit(1), F.floor(F.col("len") / 10)))
    back = F.col("len") - F.col("rn") + 1
    mean = lambda place, lo, hi: F.coalesce(F.avg(F.when((place > lo) & (place <= hi), F.col("n"))), F.lit(0.0))
    k = F.col("k")
    out = p.groupBy("image_id").agg(mean(F.col("rn"), 0, k).alias("left_tip"), mean(F.col("rn"), k, 2 * k).alias("left_neck"), mean(back, 0, k).alias("right_tip"), mean(back, k, 2 * k).alias("right_neck"))
    return out.withColumn("left_flares", F.col("left_tip") > F.col("left_neck") * flare).withColumn("right_flares", F.col("right_tip") > F.col("right_neck") * flare)


def line_fit_mse(pixels: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Mean squared residual of y over x, by least squares; a vertical line leaves the variance of y; under three points 0."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    left = F.var_pop(y) - F.coalesce(F.try_divide(F.covar_pop(x, y) * F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0))
    mse = F.when(F.count("*") < 3, F.lit(0.0)).otherwise(F.greatest(left, F.lit(0.0)))
    return pixels.groupBy("image_id").agg(mse.alias("mse")).withColumn("straight", F.col("mse") < threshold)


def intensity_bands(pixels: DataFrame) -> DataFrame:
    """Mean value of the upper and the lower quarter of the rows."""
    box = pixels.groupBy("image_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    p = pixels.join(box, "image_id").withColumn("q", F.floor((F.col("y1") - F.col("y0")) * 0.25))
    band = lambda c: F.avg(F.when(c, F.col("v").cast("double")))
    return p.groupBy("image_id").agg(band(F.col("y") <= F.col("y0") + F.col("q")).alias("top_value"), band(F.col("y") >= F.col("y1") - F.col("q")).alias("bottom_value"))


def eye_strip(body: DataFrame, eye: DataFrame, reach: int = 2) -> DataFrame:
    """The body's first and last row in the columns within reach of the eye's centroid, and the eye's centroid and area."""
    center = eye.groupBy("image_id").agg(F.count("*").alias("eye_area"), F.avg("x").alias("eye_x"), F.avg("y").alias("eye_y"))
    near = body.join(center, "image_id").where(F.col("x").between(F.floor("eye_x") - reach, F.floor("eye_x") + reach))
    return near.groupBy("image_id", "eye_area", "eye_x", "eye_y").agg(F.min("y").alias("strip_top"), F.max("y").alias("strip_bottom"))


def crop(pixels: DataFrame, boxes: DataFrame, margin: float = 0.1, px: int = 0, width: int | None = None, height: int | None = None, inclusive: bool = False) -> DataFrame:
    """Pixels inside each box grown by a share of its size and by px, moved to the crop's origin.

    The box ends before x_max and y_max, unless inclusive.
    """
    grown = boxes.select("image_id", "x_min", "x_max", "y_min", "y_max")
    for a, size in (("x", width), ("y", height)):
        grow = F.floor((F.col(f"{a}_max") - F.col(f"{a}_min")) * margin) + px
        end = F.col(f"{a}_max") + grow + int(inclusive)
        grown = grown.withColumn(f"{a}0", F.greatest(F.lit(0), F.col(f"{a}_min") - grow)).withColumn(f"{a}1", F.least(F.lit(size), end) if size else end)
    inside = pixels.join(grown.select("image_id", "x0", "x1", "y0", "y1"), "image_id").where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return inside.withColumn("x", F.col("x") - F.col("x0")).withColumn("y", F.col("y") - F.col("y0")).drop("x0", "x1", "y0", "y1")


def fill_background(image: DataFrame, mask: DataFrame, value: float) -> DataFrame:
    """Pixels outside the mask get the value."""
    inside = mask.select("image_id", "x", "y").distinct().withColumn("_in", F.lit(True))
    return image.join(inside, ["image_id", "x", "y"], "left").withColumn("v", F.when(F.col("_in"), F.col("v")).otherwise(F.lit(value).cast(image.schema["v"].dataType))).drop("_in")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of large masks, both should be dealt() alike: Spark leaves out the shuffle of the union where its sides are grouped by pixel, so that a task holds both sides and their union."""
    return a.select("image_id", "x", "y").union(b.select("image_id", "x", "y")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of both, in one group per pixel; nulls are alike. Sides that are dealt() alike stay where they are."""
    both = a.select("image_id", "x", "y", F.lit(1).alias("_in")).union(b.select("image_id", "x", "y", F.lit(2).alias("_in")))
    return both.groupBy("image_id", "x", "y").agg(F.bit_or("_in").alias("_in")).where("_in = 3").drop("_in")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("image_id", "x", "y").join(b.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_anti")


def rotate_180(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.withColumn("x", F.lit(width - 1) - F.col("x")).withColumn("y", F.lit(height - 1) - F.col("y"))


def flip_vertical(pixels: DataFrame, height: int) -> DataFrame:
    return pixels.withColumn("y", F.lit(height - 1) - F.col("y"))


def density(points: DataFrame) -> DataFrame:
    """Key points per whole pixel."""
    return points.groupBy("image_id", F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).agg(F.count("*").alias("n"))
