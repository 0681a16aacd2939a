"""Ratios of exact sums, and rounding for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_PER_DAY = 24.0


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def exact_mean(value: Column, weight: Column | None = None) -> Column:
    """Mean of whole numbers from integer sums: the same in any order of addition."""
    value = value.cast("long")
    if weight is None:
        return ratio(F.sum(value), F.count(value))
    return ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def days(hours: Column) -> Column:
    return hours / F.lit(HOURS_PER_DAY)


def shown(value: Column, places: int) -> Column:
    """Round half away from zero on the scaled double, for printed figures."""
    scale = F.lit(10.0**places)
    return F.round(value.cast("double") * scale) / scale
