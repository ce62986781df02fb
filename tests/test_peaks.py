"""Peaks against the kernel and a literal definition, with plateaus, ties, nulls and short series."""

import numpy as np
import pytest

from markwise.kernels import signals
from markwise.operators import peaks


def literal_prominence(v, p):
    left = next((i for i in range(p - 1, -1, -1) if v[i] > v[p]), 0)
    right = next((i for i in range(p + 1, len(v)) if v[i] > v[p]), len(v) - 1)
    return v[p] - max(min(v[left : p + 1]), min(v[p : right + 1]))


@pytest.mark.parametrize("distance", [1, 2, 5, 40])
def test_peaks_are_the_kernels(spark, distance):
    r = np.random.default_rng(distance)
    series = {k: r.integers(0, 5, int(n)).astype(float) for k, n in enumerate([0, 1, 2, 3, 7, 30, 200, 200])}
    series[8] = np.array([1.0, 3, 3, 3, 1, 3, 3, 2, 3, 1])
    rows = [(k, i * 2, float(x)) for k, v in series.items() for i, x in enumerate(v)] + [(6, None, 9.0), (6, 1000, None)]
    signal = spark.createDataFrame(rows, "series long, t long, v double").repartition(3)
    got = {(x.series, x.t // 2, x.v, x.prominence) for x in peaks.peaks(signal, height=2.0, distance=distance).collect()}
    want = set()
    for k, v in series.items():
        for p in signals.peaks(v, 2.0, distance):
            assert literal_prominence(v, p) == signals.prominence(v, p)
            want.add((k, int(p), v[p], literal_prominence(v, p)))
    assert got == want
    some = {(x.series, x.t // 2) for x in peaks.peaks(signal, height=2.0, distance=distance, prominence=2.0).collect()}
    assert some == {w[:2] for w in want if w[3] >= 2}


def test_heights_by_percentile_and_no_series(spark):
    v = [0.0, 1.0, 0.0, 5.0, 0.0, 2.0, 0.0, 4.0, 0.0]
    signal = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "series string, t long, v double")
    assert sorted(x.t for x in peaks.peaks(signal, percentile=0.75).collect()) == [3, 5, 7]
    assert sorted(x.t for x in peaks.peaks(signal).collect()) == [1, 3, 5, 7]
    assert peaks.peaks(signal.limit(0), percentile=0.5, distance=3).count() == 0


def test_long_series_take_time_in_proportion(spark):
    """A falling series keeps every value on the stack, and one with a peak at every other place has as many peaks."""
    import time

    n = 200_000
    signal = spark.range(n).selectExpr("1L as series", "id as t", f"cast({n} - id + 3 * (id % 2) as double) as v")
    began = time.monotonic()
    got = peaks.peaks(signal, distance=2, prominence=2.0).collect()
    assert len(got) == n // 2 - 1 and {x.prominence for x in got} == {2.0} and time.monotonic() - began < 60
