"""Geometric verification of the correspondences of image pairs."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.kernels.ransac import SAMPLE, ransac


def verify(matches: DataFrame, model: str = "affine", threshold: float = 5.0, confidence: float = 0.99, max_iterations: int = 2000) -> DataFrame:
    """(query_id, match_id, inliers, total_matches, transform) of correspondences with points qx, qy, tx, ty.

    A pair's rows are its correspondences, one per query descriptor at most, so a group is as large as one image. The
    seed is a hash of the pair and rows are sorted, so a lost executor's pairs come out the same.
    """
    if model not in SAMPLE:
        raise ValueError(f"unknown model {model!r}")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["query_idx", "train_idx"])
        m, mask = ransac(rows[["qx", "qy"]].to_numpy(float), rows[["tx", "ty"]].to_numpy(float), model, threshold, confidence, max_iterations, zlib.crc32("|".join(map(str, key)).encode()))
        return pd.DataFrame({"query_id": [key[0]], "match_id": [key[1]], "inliers": [int(mask.sum())], "total_matches": [len(rows)], "transform": [None if m is None else m.ravel().tolist()]})

    kinds = f"query_id {matches.schema['query_id'].dataType.simpleString()}, match_id {matches.schema['match_id'].dataType.simpleString()}"
    return matches.groupBy("query_id", "match_id").applyInPandas(run, f"{kinds}, inliers long, total_matches long, transform array<double>")


def inliers_given(matches: DataFrame, transform: list[float], threshold: float = 5.0) -> DataFrame:
    """(query_id, match_id, inliers, total_matches) under a fixed affine transform."""
    a, b, c, d, e, f = map(float, transform)
    dx, dy = F.col("qx") * a + F.col("qy") * b + c - F.col("tx"), F.col("qx") * d + F.col("qy") * e + f - F.col("ty")
    near = (dx * dx + dy * dy <= threshold * threshold).cast("long")
    return matches.groupBy("query_id", "match_id").agg(F.sum(near).alias("inliers"), F.count("*").alias("total_matches"))
