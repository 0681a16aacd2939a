"""Calendar arithmetic that counts boundaries crossed, in any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_diff(start: Column | str, end: Column | str) -> Column:
    """Midnights crossed from start to end: 23:59 to 00:01 is one day."""
    return F.datediff(end, start).cast("long")


def hour_boundaries(start: Column | str, end: Column | str) -> Column:
    """Full hours crossed from start to end: 10:59 to 11:01 is one hour.

    Calendar days plus clock hours, so it holds for negative gaps and never
    goes through a zoned timestamp.
    """
    return day_diff(start, end) * 24 + F.hour(end) - F.hour(start)


def month_label(ts: Column | str) -> Column:
    return F.date_format(F.to_date(ts), "yyyy-MM")


def latest_first(ts: Column) -> Column:
    """A sort key: smallest for the latest timestamp, NULL timestamps after all others."""
    return F.struct(
        ts.isNull().alias("missing"),
        (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") - ts).alias("age"),
    )
