"""Opt-in approximate promises from mergeable sketches per lane and day.

The exact calibration counts the training window anew for every cutoff.  A KLL sketch
per key and day is written once; any window is then the merge of its days, whose size
does not depend on the number of orders.  The price is a rank error, see ``rank_error``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import checked, promise_name

SKETCH_SIZE = 4096


def rank_error(k: int = SKETCH_SIZE) -> float:
    """The share of a group by which a quantile's rank may be off, with 99 % confidence.

    The published fit of KLL's single-sided error.  Groups of up to ``k`` rows are kept whole.
    """
    return 2.296 / k**0.9723


def day_sketches(
    fact: DataFrame,
    keys: Sequence[str],
    actual: str = "total_days",
    day: str = "purchase_date",
    k: int = SKETCH_SIZE,
) -> DataFrame:
    """(keys, day, n, sketch): a sketch of ``actual`` per key and day, combined before the shuffle."""
    value = F.col(actual).cast("long")
    rows = fact.where(value.isNotNull())
    return rows.groupBy(*keys, F.col(day).alias("day")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_bigint(value, F.lit(k)).alias("sketch")
    )


def merged(sketches: DataFrame, keys: Sequence[str], start: date | None = None, end: date | None = None) -> DataFrame:
    """(keys, n, sketch) over the days from ``start`` up to but not including ``end``."""
    if start is not None:
        sketches = sketches.where(F.col("day") >= F.lit(start))
    if end is not None:
        sketches = sketches.where(F.col("day") < F.lit(end))
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch")
    )


def calibrate_sketched(
    sketches: DataFrame,
    keys: Sequence[str],
    fractions: Sequence[float],
    start: date | None = None,
    end: date | None = None,
    min_orders: int = 0,
) -> DataFrame:
    """Promises per group from the sketches of a window: the least value that ``f`` of the orders do not exceed.

    Unlike ``calibrate`` it does not interpolate, so a promise is a value that occurred.
    Keys may be coarser than those of the sketches.  Days without orders need no rows.
    """
    window = merged(sketches, keys, start, end).where((F.col("n") >= min_orders) & (F.col("n") > 0))
    promises = [
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(f))).cast("int").alias(promise_name(f))
        for f in checked(fractions)
    ]
    return window.select(*keys, F.col("n").alias("n_train"), *promises)
