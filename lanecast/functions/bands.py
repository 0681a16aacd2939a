"""Ordered bands over a numeric column."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Band(NamedTuple):
    label: str
    upper: int | None


# Labels and the last whole day (or hour) that belongs to each band.
PROMISE_BANDS = (
    Band("a) 20+ days early", -20),
    Band("b) 10-20 days early", -10),
    Band("c) 5-10 days early", -5),
    Band("d) 1-5 days early", -1),
    Band("e) exactly on time", 0),
    Band("f) 1-5 days late", 5),
    Band("g) 5+ days late", None),
)
GAP_BANDS = (
    Band("a) 0-6 hours", 6),
    Band("b) 6-24 hours", 24),
    Band("c) 1-3 days", 72),
    Band("d) 3-7 days", 168),
    Band("e) over 7 days", None),
)
REVIEW_BANDS = (
    Band("a) 10+ days early", -10),
    Band("b) 1-9 days early", -1),
    Band("c) on time", 0),
    Band("d) 1-3 days late", 3),
    Band("e) 4-7 days late", 7),
    Band("f) 8-14 days late", 14),
    Band("g) 15+ days late", None),
)
REVIEW_CHART_BANDS = (
    Band("a) 10+ early", -10),
    Band("b) 1-9 early", -1),
    Band("c) on time", 0),
    Band("d) 1-3 late", 3),
    Band("e) 4-7 late", 7),
    Band("f) 8-14 late", 14),
    Band("g) 15+ late", None),
)


def band(value: Column | str, bands: Sequence[Band], closed: str = "right") -> Column:
    """Label of the first band that holds ``value``.

    ``closed="right"`` keeps the upper edge in its band, ``"left"`` passes it to
    the next one.  The last band is open, and NULL belongs to it.
    """
    if closed not in ("right", "left"):
        raise ValueError("closed is 'right' or 'left'")
    value = F.col(value) if isinstance(value, str) else value
    *bounded, rest = bands
    label = F
    for item in bounded:
        inside = value <= item.upper if closed == "right" else value < item.upper
        label = label.when(inside, item.label)
    return label.otherwise(rest.label)
