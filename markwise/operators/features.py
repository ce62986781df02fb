"""Tables of features: validity, and descriptors as colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_images(images: DataFrame, descriptors: DataFrame) -> DataFrame:
    return images.join(descriptors.select("image_id").distinct(), "image_id", "left_semi")


def by_prefix(images: DataFrame, prefix: str) -> DataFrame:
    """The first image, by name, that begins with the prefix."""
    return images.where(F.col("image_id").startswith(prefix)).orderBy("image_id").limit(1)


def descriptor_colours(descriptors: DataFrame) -> DataFrame:
    """(image_id, global_idx, r, g, b): three principal components of the unit descriptors, each from 0 to 255.

    Needs four descriptors. Signs of components are arbitrary.
    """
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = descriptors.select("image_id", "global_idx", array_to_vector(F.transform("d", lambda x: x.cast("double"))).alias("v"))
    unit = Normalizer(inputCol="v", outputCol="u").transform(v)
    out = PCA(k=3, inputCol="u", outputCol="p").fit(unit).transform(unit).withColumn("p", vector_to_array("p"))
    ends = out.agg(*[f(F.col("p")[i]).alias(f"{n}{i}") for i in range(3) for n, f in (("a", F.min), ("b", F.max))])
    j = out.crossJoin(F.broadcast(ends))
    return j.select("image_id", "global_idx", *[F.coalesce(F.try_divide(F.col("p")[i] - F.col(f"a{i}"), F.col(f"b{i}") - F.col(f"a{i}")) * 255, F.lit(0.0)).alias(c) for i, c in enumerate("rgb")])
