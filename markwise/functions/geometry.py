"""Arithmetic on pixels, angles and scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(red: Column, green: Column, blue: Column) -> Column:
    """Luma of BT.601."""
    return red * 0.299 + green * 0.587 + blue * 0.114


def rotate_x(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    return cx + (x - cx) * F.cos(F.radians(degrees)) + (y - cy) * F.sin(F.radians(degrees))


def rotate_y(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    return cy - (x - cx) * F.sin(F.radians(degrees)) + (y - cy) * F.cos(F.radians(degrees))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.coalesce(F.try_divide(area * (4 * math.pi), perimeter * perimeter), F.lit(0.0))


def darkness(value: Column) -> Column:
    return 1 - value / 255.0


def half_turn(angle: Column) -> Column:
    """An axis has no direction: its angle is taken modulo 180."""
    return F.pmod(angle, F.lit(180.0))


def facing_left(angle: Column, head_left: Column) -> Column:
    return F.when(head_left, angle).otherwise(angle + 180)


def to_mm(px: Column, per_mm: Column) -> Column:
    return F.when(per_mm > 0, px / per_mm).otherwise(F.lit(0.0))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, F.abs((value - mean) / std)).otherwise(F.lit(0.0))
