"""Image files as tables and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markwise.kernels import png
from markwise.operators.images import array

from . import files

IMAGE = "image_id string, path string, height int, width int, n_channels int, data binary"


def _stem(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1)


def scan(spark: SparkSession, folder: str, pattern: str = "*.{jpg,JPG}") -> DataFrame:
    """(image_id, path, length) of the files; contents stay unread until a column asks for them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(_stem("path").alias("image_id"), "path", "length")


#: Up to so many files that are to be turned are sent to every task; beyond, decoded images are joined to them.
TURNED = 100_000


def _local(path: str) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:///")


def turned(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, orientation) of the files whose tag says that they aren't upright."""
    heads = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(_local("path").alias("path"), F.substring("content", 1, 65536).alias("head"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = part[["path"]].assign(orientation=[png.exif_orientation(x or b"") for x in part["head"]])
            yield own[own["orientation"] > 1]

    return heads.mapInPandas(run, "path string, orientation int")


def read(spark: SparkSession, folder: str, pattern: str = "*.{jpg,JPG,png}", upright: bool = True, most_turned: int = TURNED) -> DataFrame:
    """Decoded images, gray or RGB, turned as their orientation tag says (upright). Files that don't decode are in unreadable().

    Few files are turned, so their tags are read first and go to the tasks that decode: pixels aren't shuffled.
    """
    decoded = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    own = decoded.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    tags = turned(spark, folder, pattern) if upright else None
    few = tags.limit(most_turned + 1).collect() if upright else []
    known = {r["path"]: r["orientation"] for r in few} if len(few) <= most_turned else None
    if known is None:
        own = own.withColumn("path", _local("origin")).join(tags, "path", "left").drop("path")
    else:
        own = own.withColumn("orientation", F.lit(None).cast("int"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                x = array(r.height, r.width, r.nChannels, r.data)
                if x.ndim == 3:
                    x = x[:, :, 2::-1]  # the source gives BGR
                way = known.get(re.sub("^file:/+", "file:///", r.origin), 1) if known is not None else r.orientation
                x = np.ascontiguousarray(png.upright(x, int(way) if way and way == way else 1))
                rows.append((re.sub(r"\.[^./]*$", "", r.origin.rsplit("/", 1)[-1]), r.origin, x.shape[0], x.shape[1], 1 if x.ndim == 2 else 3, x.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in IMAGE.split(", ")])

    return own.mapInPandas(run, IMAGE)


#: Prompts of the method, as masks are named after them.
PROMPTS = ("whole fish", "fish", "fish eye", "dorsal fin", "ruler")


def unreadable(spark: SparkSession, folder: str, pattern: str = "*.{jpg,JPG,png}") -> DataFrame:
    """(image_id, path, error) of the files that read() leaves out."""
    files = spark.read.format("image").option("pathGlobFilter", pattern).load(folder).select("image.origin", "image.height")
    return files.where("height <= 0").select(_stem("origin").alias("image_id"), F.col("origin").alias("path"), F.lit("not an image").alias("error"))


def mask_name(name: str, prompts: tuple[str, ...] = PROMPTS) -> tuple[str, str]:
    """Image and prompt of {image}_{prompt}_mask: the longest known prompt at the end, else what stands behind the last _."""
    name = name.removesuffix("_mask")
    for p in sorted(prompts, key=len, reverse=True):
        if name.endswith("_" + p.replace(" ", "_")):
            return name[: -len(p) - 1], p
    image, _, prompt = name.rpartition("_")
    return (image, prompt) if image else (name, "")


def mask_names(name: Column, prompts: tuple[str, ...] = PROMPTS) -> tuple[Column, Column]:
    """mask_name() as columns: image, and prompt with _ for spaces; both empty for other names."""
    known = "|".join(re.escape(p.replace(" ", "_")) for p in sorted(prompts, key=len, reverse=True))
    return tuple(F.regexp_extract(name, f"^(.+?)_({known})_mask$", i) for i in (1, 2))


def read_masks(spark: SparkSession, folder: str, prompts: tuple[str, ...] = PROMPTS) -> DataFrame:
    """masks from files {image}_{prompt}_mask.png; any value above 0 is set. Spaces of a prompt are written as _."""
    own = read(spark, folder, "*_mask.png", upright=False)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                m = array(r.height, r.width, r.n_channels, r.data)
                m = (m if m.ndim == 2 else m.max(2)) > 0
                rows.append((*mask_name(r.image_id, prompts), r.height, r.width, int(m.sum()), m.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "prompt", "height", "width", "area", "mask"])

    return own.mapInPandas(run, "image_id string, prompt string, height int, width int, area long, mask binary")


def png_files(images: DataFrame) -> DataFrame:
    """(image_id, content): each image as a PNG file, to be written as a table or exported."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"image_id": part["image_id"], "content": [png.encode(array(r.height, r.width, r.n_channels, r.data)) for r in part.itertuples()]})

    return images.mapInPandas(run, "image_id string, content binary")


def export(images: DataFrame, folder: str, suffix: str = ".png") -> None:
    """Writes (image_id, content) as single files, all of them or none (sources.files)."""
    files.export(images, folder, suffix)


def mask_files(masks: DataFrame) -> DataFrame:
    """(image_id, content) of masks as PNG files, named {image}_{prompt}_mask."""
    named = masks.select(F.concat_ws("_", "image_id", F.replace("prompt", F.lit(" "), F.lit("_")), F.lit("mask")).alias("image_id"), "height", "width", F.lit(1).alias("n_channels"), "mask")
    scaled = F.unhex(F.regexp_replace(F.hex("mask"), "01", "FF"))
    return png_files(named.select("image_id", "height", "width", "n_channels", scaled.alias("data")))


def names(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(name) of the files in a folder, without their ending; none if there is no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "name string")
    return scan(spark, folder, pattern).select(F.col("image_id").alias("name"))
