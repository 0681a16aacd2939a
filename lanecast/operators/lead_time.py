"""The order base table, the lead-time segments, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import day_diff, days, hour_boundaries, pct, ratio
from ..settings import Settings
from .distribution import distribution, quantiles, rows_of, value_counts, value_of

SEGMENTS = ("approval", "handoff", "transit")
SEGMENT_HOURS = tuple(f"{name}_hours" for name in SEGMENTS)


def in_base(s: Settings) -> Column:
    """Delivered, complete, inside the window, and no corrupt approval gap.

    The gap is signed: it drops approvals far later than the carrier scan and
    keeps the rest.  Status and window are plain comparisons that reach the scan.
    """
    purchase = F.col("order_purchase_timestamp")
    gap = hour_boundaries("order_delivered_carrier_date", "order_approved_at")
    return (
        (F.col("order_status") == s.status)
        & (purchase >= F.lit(s.window_start.isoformat(" ")).cast("timestamp_ntz"))
        & (purchase < F.lit(s.window_end.isoformat(" ")).cast("timestamp_ntz"))
        & F.col("order_approved_at").isNotNull()
        & F.col("order_delivered_carrier_date").isNotNull()
        & F.col("order_delivered_customer_date").isNotNull()
        & (gap <= s.max_gap_hours)
    )


def build_base(orders: DataFrame, s: Settings) -> DataFrame:
    """One row per order that can be measured; a narrow step, batch or stream.

    ``is_late`` compares moments and ``promise_error_days`` compares dates, so an
    order that arrives during its promised day may be late with an error of 0.
    Orders landed by month are read for the window's months only.
    """
    if "purchase_month" in orders.columns:
        # The end is exclusive: a window that ends with a month does not read the next.
        first, last = (f"{t:%Y-%m}" for t in (s.window_start, s.window_end - timedelta(microseconds=1)))
        orders = orders.where(F.col("purchase_month").between(first, last))
    delivered = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    approved = F.col("order_approved_at")
    shipped = F.col("order_delivered_carrier_date")
    purchase = F.col("order_purchase_timestamp")
    return orders.where(in_base(s)).select(
        "order_id",
        "customer_id",
        purchase.alias("purchased_at"),
        approved.alias("approved_at"),
        shipped.alias("shipped_at"),
        delivered.alias("delivered_at"),
        promised.alias("promised_at"),
        day_diff(purchase, delivered).alias("total_days"),
        day_diff(promised, delivered).alias("promise_error_days"),
        (delivered > promised).alias("is_late"),
        (shipped < approved).alias("approval_suspect"),
    )


def with_segments(base: DataFrame) -> DataFrame:
    """Whole hours from purchase to approval, to the carrier, to the customer."""
    return base.withColumns(
        {
            "approval_hours": hour_boundaries("purchased_at", "approved_at"),
            "handoff_hours": hour_boundaries("approved_at", "shipped_at"),
            "transit_hours": hour_boundaries("shipped_at", "delivered_at"),
        }
    )


def base_events(base: DataFrame, steps: Mapping[str, str], key: str = "order_id") -> DataFrame:
    """(key, step, at) rows from a table with a column per step; ``steps`` maps step to column."""
    rows = [F.struct(F.lit(step).alias("step"), F.col(c).alias("at")) for step, c in steps.items()]
    return base.select(key, F.inline(F.array(*rows))).where(F.col("at").isNotNull())


def chain_segments(
    events: DataFrame, chain: Sequence[str], unit: str = "day", key: str = "order_id"
) -> DataFrame:
    """Time between the steps of a chain of any length, from event rows (key, step, at).

    One row per key and step that has a predecessor: ``from_step``, ``to_step``, ``length``
    in ``unit`` (day, hour or minute) and ``n_skipped``, the steps of the chain between the
    two that have no event.  Boundaries of hours (minutes) are counted, so a key's
    segments add up to the whole from its first to its last step, whatever is
    missing.  Steps follow the chain, not the clock: a step before its predecessor
    gives a negative length.  Of several events of a step the first counts.  Events of other
    steps, and those without a moment or a key, are left out.  One shuffle by key.
    """
    if len(set(chain)) < len(chain) or len(chain) < 2:
        raise ValueError(f"a chain needs two or more different steps: {tuple(chain)}")
    if unit not in ("day", "hour", "minute"):
        raise ValueError(f"unknown unit {unit}")
    place = F.array_position(F.array(*map(F.lit, chain)), F.col("step")).cast("int")
    known = events.where(F.col("step").isin(*chain) & F.col("at").isNotNull() & F.col(key).isNotNull())
    # Repeated events of a step are combined before they move.
    first = known.groupBy(key, place.alias("place")).agg(F.min("at").alias("at"))
    along = Window.partitionBy(key).orderBy("place")
    paired = first.select(
        key, "place", "at", F.lead("place").over(along).alias("next"), F.lead("at").over(along).alias("next_at")
    ).where(F.col("next").isNotNull())
    if unit == "minute":
        length = F.timestamp_diff("MINUTE", F.date_trunc("minute", "at"), F.date_trunc("minute", "next_at"))
    else:
        hours = hour_boundaries("at", "next_at")
        length = days(hours) if unit == "day" else hours
    names = F.array(*map(F.lit, chain))
    return paired.select(
        key,
        names[F.col("place") - 1].alias("from_step"),
        names[F.col("next") - 1].alias("to_step"),
        length.alias("length"),
        (F.col("next") - F.col("place") - 1).alias("n_skipped"),
    )


def segments_in_days(df: DataFrame) -> DataFrame:
    """Replace the hour columns by days."""
    converted = {f"{s}_hours": days(F.col(f"{s}_hours")).alias(f"{s}_days") for s in SEGMENTS}
    return df.select([converted.get(c, F.col(c)) for c in df.columns])


def trusted(df: DataFrame) -> DataFrame:
    """Rows whose approval time is credible."""
    return df.where(~F.col("approval_suspect"))


def headline(base: DataFrame) -> DataFrame:
    counted = base.groupBy("total_days", "promise_error_days").agg(
        F.count("*").alias("n"),
        F.count_if("is_late").alias("late"),
        F.count("is_late").alias("late_known"),
        F.count_if("approval_suspect").alias("suspect"),
    )
    total, error = F.col("total_days"), F.col("promise_error_days")
    error_rows = F.sum(F.when(error.isNotNull(), F.col("n")))
    return counted.agg(
        F.sum("n").alias("n_orders"),
        ratio(F.sum(total * F.col("n")), F.sum("n")).alias("mean_days"),
        quantiles(total, 0.5, 0.95).alias("q"),
        pct(F.sum("late"), F.sum("late_known")).alias("pct_late"),
        ratio(F.sum(error * F.col("n")), error_rows).alias("mean_promise_error"),
        F.sum("suspect").alias("n_approval_suspect"),
    ).select(
        "n_orders",
        "mean_days",
        F.col("q")[0].alias("median_days"),
        F.col("q")[1].alias("p95_days"),
        "pct_late",
        "mean_promise_error",
        "n_approval_suspect",
    )


def promise_error_percentiles(base: DataFrame) -> DataFrame:
    error = F.col("promise_error_days")
    counted = base.groupBy("promise_error_days").agg(F.count("*").alias("n"))
    marks = {"p05": 0.05, "p25": 0.25, "median_error": 0.50, "p75": 0.75, "p95": 0.95}
    return counted.agg(
        F.min(error).alias("min_error"),
        quantiles(error, *marks.values()).alias("q"),
        F.max(error).alias("max_error"),
    ).select(
        "min_error", *[F.col("q")[i].alias(name) for i, name in enumerate(marks)], "max_error"
    )


def segment_distributions(segments: DataFrame) -> DataFrame:
    """Per segment: mean, median, p95, sample deviation and tail spread in days."""
    hours = distribution(trusted(segments), SEGMENT_HOURS, {"median": 0.5, "p95": 0.95})
    return hours.select(
        F.regexp_replace("measure", "_hours$", "").alias("segment"),
        days(F.col("mean")).alias("mean_days"),
        days(F.col("median")).alias("median_days"),
        days(F.col("p95")).alias("p95_days"),
        days(F.col("stddev")).alias("stddev_days"),
        days(F.col("p95") - F.col("median")).alias("tail_spread"),
    ).orderBy("segment")


def segment_share(segments: DataFrame) -> DataFrame:
    """Mean of each segment and its part of the mean total.

    The total is in calendar days, so the parts may add up to more than 100.
    """
    sums = trusted(segments).agg(
        F.sum("total_days").alias("total"),
        F.count("*").alias("n"),
        *[F.sum(h).alias(h) for h in SEGMENT_HOURS],
    )
    return sums.select(
        *[days(ratio(F.col(f"{s}_hours"), F.col("n"))).alias(s) for s in SEGMENTS],
        *[
            pct(F.col(f"{s}_hours"), F.col("total") * 24).alias(f"pct_{s}")
            for s in SEGMENTS
        ],
    )


def segments_by_lateness(segments: DataFrame) -> DataFrame:
    counted = value_counts(trusted(segments), SEGMENT_HOURS, ["is_late"])
    return counted.groupBy("is_late").agg(
        rows_of(SEGMENT_HOURS[0]).alias("n_orders"),
        *[days(quantiles(value_of(f"{s}_hours"), 0.5)[0]).alias(s) for s in SEGMENTS],
    )


def segment_sum_check(segments: DataFrame) -> DataFrame:
    hours = sum(F.col(h) for h in SEGMENT_HOURS)
    sums = trusted(segments).agg(
        F.count("*").alias("n_orders"),
        F.sum(hours).alias("hours"),
        F.sum("total_days").alias("days"),
    )
    by_segments = days(ratio(F.col("hours"), F.col("n_orders")))
    by_total = ratio(F.col("days"), F.col("n_orders"))
    return sums.select(
        "n_orders",
        by_segments.alias("sum_of_segments"),
        by_total.alias("total_days_col"),
        (by_segments - by_total).alias("gap"),
    )
