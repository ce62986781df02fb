"""Peaks of series signal(series, t, v) with a least height, a least distance and a least prominence.

A peak is a value, or the middle of equal values (rounded down), that is higher than what stands on both sides; the first and last values
are none. Heights are judged first, then distances (the higher peak suppresses the lower; of equal ones the later the earlier), then prominences. A group holds one
series, of which each pass takes time in proportion to the length; nulls in t or v are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _apart(place: np.ndarray, v: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks no higher one nearer than the distance suppresses."""
    at, out = place.tolist(), [True] * len(place)
    for i in np.lexsort((place, v))[::-1].tolist():
        if out[i]:
            for way in (-1, 1):
                j = i + way
                while 0 <= j < len(at) and abs(at[j] - at[i]) < distance:
                    out[j] = False
                    j += way
    return np.array(out, bool)


def _lowest(values: list[float]) -> list[float]:
    """For each value the lowest one since the last higher one, itself included, or since the start.

    The stack's values fall from its bottom to its top, each with the lowest one since the value below it: a new value takes the
    place of all that aren't higher, and of what they knew.
    """
    stack: list[tuple[float, float]] = []
    out = []
    for v in values:
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        stack.append((v, low))
        out.append(low)
    return out


def peaks(signal: DataFrame, height: float | None = None, distance: int = 1, prominence: float | None = None, percentile: float | None = None) -> DataFrame:
    """(series, t, v, prominence) of the peaks; percentile: the least height is that percentile (0 to 1) of the series' values."""
    kind, t_kind = (signal.schema[c].dataType.simpleString() for c in ("series", "t"))

    def least_height(v: np.ndarray) -> float:
        if percentile is None:
            return -math.inf if height is None else height
        ranked, place = np.sort(v), (len(v) - 1) * percentile
        low, high = math.floor(place), math.ceil(place)
        return float(ranked[low] if low == high or ranked[low] == ranked[high] else (high - place) * ranked[low] + (place - low) * ranked[high])

    def find(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("t", "ascending"), ("v", "ascending")])
        v = rows["v"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))  # of each run of equal values
        last, own = np.append(first[1:], len(v)) - 1, v[first]
        top = np.flatnonzero((own[1:-1] > own[:-2]) & (own[1:-1] > own[2:])) + 1
        top = top[own[top] >= least_height(v)]
        place = (first[top] + last[top]) // 2
        if distance > 1:
            keep = _apart(place, own[top], distance)
            top, place = top[keep], place[keep]
        if len(top):
            left, right = np.array(_lowest(own.tolist())), np.array(_lowest(own[::-1].tolist()))[::-1]
            high = own[top] - np.maximum(left[top], right[top])
        else:
            high = np.zeros(0)
        if prominence is not None:
            keep = high >= prominence
            place, high = place[keep], high[keep]
        out = rows.take(pa.array(place, pa.int64()))
        return pa.table([out["series"], out["t"], out["v"], pa.array(high, pa.float64())], names=["series", "t", "v", "prominence"])

    known = signal.where("t is not null and v is not null").select("series", "t", F.col("v").cast("double").alias("v"))
    return known.groupBy("series").applyInArrow(find, f"series {kind}, t {t_kind}, v double, prominence double")
