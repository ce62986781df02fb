"""Functions of float vectors held in array columns; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for an empty vector or one of norm 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def root_normalised(d: Column | str) -> Column:
    """The square root of each component's share of the component sum."""
    total = _total(F.transform(_col(d), lambda x: x.cast("double"))) + 1e-7
    return F.transform(_col(d), lambda x: F.sqrt(x.cast("double") / total))


def blend(a: Column | str, b: Column | str, share: float) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * share + y.cast("double") * (1 - share))
