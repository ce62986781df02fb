"""Which way an animal faces: column expressions over one row of measures per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pixels as px

LEAST_EYE = 10


def _scaled(distance: Column, size: Column, factor: float, most: float, without: float) -> Column:
    return F.when(size > 0, F.least(F.lit(most), F.abs(distance) / size * factor)).otherwise(F.lit(without))


def head_from_masks(body: DataFrame, eye: DataFrame) -> DataFrame:
    """(image_id, head_right, confidence): by the eye if its mask has more than LEAST_EYE pixels, else by mass."""
    own = body.groupBy("image_id").agg(F.avg("x").alias("cx"), ((F.min("x") + F.max("x")) / 2).alias("box_x"), F.count_distinct("x").alias("width"))
    seen = eye.groupBy("image_id").agg(F.count("*").alias("eye_area"), F.avg("x").alias("eye_x"))
    j = own.join(seen, "image_id", "left")
    by_eye = F.coalesce(F.col("eye_area"), F.lit(0)) > LEAST_EYE
    return j.select(
        "image_id",
        F.when(by_eye, F.col("eye_x") > F.col("cx")).otherwise(F.col("cx") > F.col("box_x")).alias("head_right"),
        F.when(by_eye, _scaled(F.col("eye_x") - F.col("cx"), F.col("width"), 2.0, 1.0, 0.7)).otherwise(_scaled(F.col("cx") - F.col("box_x"), F.col("width"), 1.5, 0.7, 0.5)).alias("confidence"),
    )


def dorsal_from_masks(body: DataFrame, eye: DataFrame, fin: DataFrame) -> DataFrame:
    """(image_id, dorsal_up, confidence): by the eye against its column of the body, the fin, or the body's values v."""
    own = body.groupBy("image_id").agg(F.avg("y").alias("cy"), F.count_distinct("y").alias("height"), (F.max("y") - F.min("y")).alias("extent"))
    strip = px.eye_strip(body, eye).where(F.col("eye_area") > LEAST_EYE)
    fins = fin.groupBy("image_id").agg(F.count("*").alias("fin_area"), F.avg("y").alias("fin_y")).where(F.col("fin_area") > LEAST_EYE)
    j = own.join(strip, "image_id", "left").join(fins, "image_id", "left").join(px.intensity_bands(body), "image_id", "left")
    above, below = F.col("eye_y") - F.col("strip_top"), F.col("strip_bottom") - F.col("eye_y")
    by_eye, by_fin, by_value = F.col("eye_area").isNotNull(), F.col("fin_area").isNotNull(), (F.col("extent") > 0) & F.col("top_value").isNotNull()
    return j.select(
        "image_id",
        F.when(by_eye, above < below).when(by_fin, F.col("fin_y") < F.col("cy")).when(by_value, F.col("top_value") < F.col("bottom_value")).otherwise(F.lit(True)).alias("dorsal_up"),
        F.when(by_eye, _scaled(above - below, F.col("strip_bottom") - F.col("strip_top"), 3.0, 1.0, 0.8))
        .when(by_fin, _scaled(F.col("fin_y") - F.col("cy"), F.col("height"), 2.0, 1.0, 0.7))
        .when(by_value, F.least(F.lit(0.7), F.abs(F.col("top_value") - F.col("bottom_value")) / 50.0)).otherwise(F.lit(0.5)).alias("confidence"),
    )


def _vote(on: Column, weight: Column | int) -> Column:
    return F.when(on, F.lit(weight) if isinstance(weight, int) else weight).otherwise(F.lit(0))


def head_from_shape(body: DataFrame, eyes: DataFrame | None = None, tails: DataFrame | None = None) -> DataFrame:
    """(image_id, head_left, confidence) by weighted votes of the mask's shape.

    eyes: (image_id, eye_left, eye_confidence); tails: (image_id, head_left_by_tail, tail_confidence), the V-shape's vote.
    """
    j = px.moments(body).join(px.half_profile_stats(body, "x"), "image_id").join(px.tips(body), "image_id")
    j = j.join(eyes, "image_id", "left") if eyes is not None else j.withColumns({"eye_left": F.lit(None).cast("boolean"), "eye_confidence": F.lit(0.0)})
    j = j.join(tails, "image_id", "left") if tails is not None else j.withColumns({"head_left_by_tail": F.lit(None).cast("boolean"), "tail_confidence": F.lit(0.0)})
    eye, tail = F.coalesce("eye_confidence", F.lit(0.0)), F.coalesce("tail_confidence", F.lit(0.0))
    mass, width = F.col("cx") < F.col("box_x"), F.col("mean_first") > F.col("mean_second")
    flare_right, flare_left = F.col("right_flares") & ~F.col("left_flares"), F.col("left_flares") & ~F.col("right_flares")
    eye_w, tail_w = F.floor(eye * 5).cast("int") + 3, F.floor(tail * 2).cast("int") + 2
    left = _vote(F.col("eye_left"), eye_w) + _vote(mass, 1) + _vote(width, 1) + _vote(flare_right, 2) + _vote(F.col("head_left_by_tail"), tail_w)
    right = _vote(~F.col("eye_left"), eye_w) + _vote(~mass, 1) + _vote(~width, 1) + _vote(flare_left, 2) + _vote(~F.col("head_left_by_tail"), tail_w)
    j = j.withColumn("_l", left).withColumn("_r", right)
    margin = F.abs(F.col("_l") - F.col("_r")) / F.greatest(F.col("_l") + F.col("_r"), F.lit(1))
    sure = F.when(eye > 0, eye * 0.5 + tail * 0.3 + margin * 0.2).when(tail > 0.5, tail * 0.6 + margin * 0.4).otherwise(margin)
    sure = F.when(flare_right | flare_left, F.least(F.lit(1.0), sure * 1.2)).otherwise(sure)
    sure = F.when(tail > 0.7, F.least(F.lit(1.0), sure * 1.15)).otherwise(sure)
    return j.select("image_id", (F.col("_l") > F.col("_r")).alias("head_left"), sure.alias("confidence"))


def dorsal_from_shape(body: DataFrame, eyes: DataFrame | None = None, fins: DataFrame | None = None) -> DataFrame:
    """(image_id, dorsal_up, confidence) by weighted votes; halves of very unlike deviation decide alone.

    eyes: (image_id, eye_top, eye_confidence); fins: (image_id, fin_top, fin_confidence).
    """
    j = px.half_profile_stats(body, "y").join(px.convexity(body), "image_id").join(px.edge_roughness(body), "image_id")
    j = j.join(eyes, "image_id", "left") if eyes is not None else j.withColumns({"eye_top": F.lit(None).cast("boolean"), "eye_confidence": F.lit(0.0)})
    j = j.join(fins, "image_id", "left") if fins is not None else j.withColumns({"fin_top": F.lit(None).cast("boolean"), "fin_confidence": F.lit(0.0)})
    eye, fin = F.coalesce("eye_confidence", F.lit(0.0)), F.coalesce("fin_confidence", F.lit(0.0))
    votes = [
        (F.col("eye_top"), F.floor(eye * 5).cast("int") + 4), (F.col("fin_top"), F.floor(fin * 5).cast("int") + 3), (F.col("std_first") > F.col("std_second"), 2),
        (F.col("widest") - 1 < F.floor(F.col("len") / 2), 1), (F.col("convexity_top") < F.col("convexity_bottom"), 1), (F.col("top_roughness") > F.col("bottom_roughness"), 1),
    ]
    up, down = F.lit(0), F.lit(0)
    for on, weight in votes:
        up, down = up + _vote(on, weight), down + _vote(~on, weight)
    unlike = F.abs(F.col("std_first") - F.col("std_second")) / (F.greatest("std_first", "std_second") + 1e-6)
    j = j.withColumn("_u", up).withColumn("_d", down).withColumn("_x", unlike)
    margin = F.abs(F.col("_u") - F.col("_d")) / F.greatest(F.col("_u") + F.col("_d"), F.lit(1))
    strong = F.col("_x") > 0.3
    steady = F.when(strong, F.least(F.lit(1.0), F.col("_x"))).otherwise(F.lit(0.5))
    sure = F.when(eye > 0, eye * 0.5 + fin * 0.25 + steady * 0.15 + margin * 0.1).when(fin > 0, fin * 0.5 + steady * 0.3 + margin * 0.2).otherwise(steady * 0.6 + margin * 0.4)
    sure = F.when(F.col("_x") > 0.5, F.least(F.lit(1.0), sure * 1.3)).otherwise(sure)
    sure = F.when(eye > 0.8, F.least(F.lit(1.0), sure * 1.2)).otherwise(sure)
    flat = F.col("len") <= 1
    return j.select("image_id", F.when(flat, F.lit(True)).when(strong, F.col("std_first") > F.col("std_second")).otherwise(F.col("_u") > F.col("_d")).alias("dorsal_up"), F.when(flat, F.lit(0.5)).otherwise(sure).alias("confidence"))


def validate(body: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, valid, score); sizes: (image_id, height, width, head_right, head_confidence, dorsal_confidence)."""
    j = sizes.join(px.half_profile_stats(body, "x").join(body.groupBy("image_id").agg(F.count("*").alias("area")), "image_id"), "image_id", "left")
    wider = F.when(F.col("head_right"), F.col("mean_second") > F.col("mean_first")).otherwise(F.col("mean_first") > F.col("mean_second"))
    score = (F.col("head_confidence") + F.col("dorsal_confidence")) / 2.0 * 0.4 + F.when(wider, 1.0).otherwise(0.5) * 0.4 + 0.2
    empty, small = F.col("height") * F.col("width") == 0, F.coalesce("area", F.lit(0)) < F.col("height") * F.col("width") * 0.1
    return j.select("image_id", F.when(empty | small, F.lit(False)).otherwise(score > 0.6).alias("valid"), F.when(empty, F.lit(0.0)).when(small, F.lit(0.3)).otherwise(score).alias("score"))
