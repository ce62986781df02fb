"""Functions of image names such as CSDD001L_standardized: animal, side and processing suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = "_standardized"


def side(name: Column | str) -> Column:
    """The first L or R anywhere in the name, null without one (so JAVR0982L gives R)."""
    return F.nullif(F.regexp_extract(name, "([LR])", 1), F.lit(""))


def side_suffix(name: Column | str) -> Column:
    """The L or R that ends the name, before the processing suffix."""
    return F.nullif(F.regexp_extract(name, f"([LR])({SUFFIX})?$", 1), F.lit(""))


def strip_suffix(name: Column | str) -> Column:
    return F.regexp_replace(name, SUFFIX, "")


def animal(name: Column | str) -> Column:
    """The name without its L and R."""
    return F.regexp_replace(name, "[RL]", "")


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
