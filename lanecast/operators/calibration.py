"""Promise recalibration on counted cells.

A fact row matters to calibration and evaluation only through its lane, state,
total days and promise error.  ``promise_cells`` counts those combinations once,
which also takes the weight off any hot lane; everything after works on cells.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pct, ratio
from .distribution import quantiles, share_of_total

TRAIN, TEST = "1_train", "2_test"


def split_label(cutoff: date, column: str = "purchase_date") -> Column:
    return F.when(F.col(column) < F.lit(cutoff), TRAIN).otherwise(TEST)


def temporal_split(fact: DataFrame, cutoff: date) -> DataFrame:
    """Size and date range on both sides of the cutoff."""
    return (
        fact.groupBy(split_label(cutoff).alias("split"))
        .agg(
            F.count("*").alias("n_orders"),
            F.min("purchase_date").alias("first_date"),
            F.max("purchase_date").alias("last_date"),
        )
        .orderBy("split")
    )


def promise_cells(fact: DataFrame, cutoff: date) -> DataFrame:
    """Orders counted by split, lane, destination, total days and promise error."""
    return fact.groupBy(
        split_label(cutoff).alias("split"),
        "lane",
        "customer_state",
        "total_days",
        "promise_error_days",
    ).agg(F.count("*").alias("n"))


def side(cells: DataFrame, label: str) -> DataFrame:
    return cells.where(F.col("split") == label)


def threshold_coverage(
    fact: DataFrame, cutoff: date, thresholds: Sequence[int] | None = None
) -> DataFrame:
    """Per threshold: lanes with that much history and the test orders they cover.

    One pass over the fact.  Lanes are summed by the size of their history, and suffix
    sums over those sizes answer any number of thresholds, so the cost is lanes plus
    thresholds.  Histories add up to the training orders, so there are at most
    the square root of twice as many sizes.  Without ``thresholds`` the whole curve is
    returned, a row per size.  A test lane without history only counts in the total; a
    NULL lane has history but matches no test order.
    """
    trained = F.col("purchase_date") < F.lit(cutoff)
    per_lane = fact.groupBy("lane").agg(
        F.count_if(trained).alias("n_train"), F.count_if(~trained).alias("n_test")
    )
    served = F.when(F.col("lane").isNotNull(), F.col("n_test")).otherwise(0)
    sizes = per_lane.groupBy("n_train").agg(
        F.count("*").alias("lanes"), F.sum(served).alias("served"), F.sum("n_test").alias("all_test")
    )
    every = Window.partitionBy()
    sizes = sizes.withColumn("all_test", F.sum("all_test").over(every)).where("n_train > 0")
    if thresholds is None:
        asked = sizes.select(F.col("n_train").alias("min_orders"))
    else:
        # One literal, however long the list.
        listed = F.from_json(F.lit(json.dumps(sorted({int(t) for t in thresholds}))), "array<bigint>")
        asked = fact.sparkSession.range(1).select(F.explode(listed).alias("min_orders"))
    none = F.lit(0).cast("long")
    marks = sizes.select(
        F.lit(None).cast("long").alias("min_orders"), F.col("n_train").alias("size"), "lanes", "served", "all_test"
    ).union(
        asked.select(
            "min_orders", F.greatest("min_orders", F.lit(1)), none, none, F.lit(None).cast("long")
        )
    )
    # From the longest history down; sizes stand before the thresholds they meet.
    down = Window.orderBy(F.desc("size"), F.asc_nulls_first("min_orders")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = marks.select(
        "min_orders",
        F.sum("lanes").over(down).alias("n_lanes"),
        F.sum("served").over(down).alias("test_orders_covered"),
        F.max("all_test").over(every).alias("all_test"),
    )
    # A sum over no lanes is NULL.
    covered = F.when(F.col("n_lanes") > 0, F.col("test_orders_covered"))
    return (
        summed.where("min_orders IS NOT NULL AND all_test IS NOT NULL")
        .select(
            "min_orders",
            "n_lanes",
            covered.alias("test_orders_covered"),
            pct(covered, F.col("all_test")).alias("pct_covered"),
        )
        .orderBy("min_orders")
    )


def mark(fraction: float) -> str:
    """A quantile as it stands in names: 0.9 is 90, 0.994 is 99_4."""
    percent = (Decimal(str(fraction)) * 100).normalize()
    return f"{percent:f}".replace(".", "_")


def checked(fractions: Sequence[float]) -> list[float]:
    """The quantiles in ascending order; none, equal or impossible ones are refused."""
    found = sorted(fractions)
    if not found or len(set(found)) < len(found) or not 0 < found[0] <= found[-1] <= 1:
        raise ValueError(f"quantiles must be different and within (0, 1]: {tuple(fractions)}")
    return found


def promise_name(fraction: float) -> str:
    return f"promise_{mark(fraction)}"


def new_name(fraction: float) -> str:
    return f"new_{mark(fraction)}"


def policies(fractions: Sequence[float]) -> dict[str, str]:
    """Policy names and the promise column each one quotes."""
    found = {f"recal_p{mark(f)}": new_name(f) for f in checked(fractions)}
    return {"current": "current_promise_days", **found}


def calibrate(
    counted: DataFrame,
    keys: Sequence[str],
    fractions: Sequence[float],
    min_orders: int = 0,
    actual: str = "total_days",
) -> DataFrame:
    """Promises per group: each quantile of the actual days, rounded up.

    No keys gives the single national row.  ``counted`` holds (keys, actual, n).
    """
    marks = quantiles(F.col(actual), *fractions).alias("q")
    promises = [
        F.ceil(F.col("q")[i]).cast("int").alias(promise_name(f)) for i, f in enumerate(fractions)
    ]
    if not keys:
        return counted.agg(marks).select(*promises)
    table = counted.groupBy(*keys).agg(F.sum("n").alias("n_train"), marks)
    return table.where(F.col("n_train") >= min_orders).select(*keys, "n_train", *promises)


def count_days(fact: DataFrame, keys: Sequence[str], actual: str = "total_days") -> DataFrame:
    return fact.groupBy(*keys, actual).agg(F.count("*").alias("n"))


class Tier(NamedTuple):
    label: str
    key: str
    table: DataFrame


def tiered_lookup(
    df: DataFrame,
    tiers: Sequence[Tier],
    last_label: str,
    last: DataFrame,
    values: Mapping[str, str],
    source: str,
) -> DataFrame:
    """Values from the first tier whose key matches, else from the one-row ``last``.

    Tier tables are left-joined by key; the planner broadcasts those it measures
    as small and shuffles the others.  NULL keys match no tier.
    """
    hits = []
    for i, tier in enumerate(tiers):
        columns = [F.col(v).alias(f"_{i}_{v}") for v in values.values()]
        slim = tier.table.select(tier.key, F.lit(True).alias(f"_{i}"), *columns)
        df = df.join(slim, tier.key, "left")
        hits.append(F.col(f"_{i}"))
    fallback = last.select(F.struct(*values.values())).scalar()
    label = F
    for hit, tier in zip(hits, tiers):
        label = label.when(hit, tier.label)
    found = {
        out: F.coalesce(*[F.col(f"_{i}_{v}") for i in range(len(tiers))], fallback.getField(v))
        for out, v in values.items()
    }
    helpers = [c for c in df.columns if c.startswith("_")]
    return df.withColumns({**found, source: label.otherwise(last_label)}).drop(*helpers)


def with_current_promise(df: DataFrame) -> DataFrame:
    """The promise shown at checkout, in days from purchase."""
    shown = F.col("total_days") - F.col("promise_error_days")
    return df.withColumn("current_promise_days", shown)


def apply_promises(
    df: DataFrame,
    lane: DataFrame,
    state: DataFrame,
    national: DataFrame,
    fractions: Sequence[float],
) -> DataFrame:
    """Test rows (or cells) with the current promise and the recalibrated ones."""
    return tiered_lookup(
        with_current_promise(df),
        [Tier("1_lane", "lane", lane), Tier("2_state", "customer_state", state)],
        "3_national",
        national,
        {new_name(f): promise_name(f) for f in checked(fractions)},
        "promise_source",
    )


def evaluate_policies(
    cells: DataFrame,
    policies: Mapping[str, str],
    keys: Sequence[str] = (),
    actual: str = "total_days",
) -> DataFrame:
    """Exact sums per policy (and key) from one pass over cells.

    ``on_time`` counts arrivals within the promise, ``judged`` the rows that have
    one, ``promised`` and ``saved`` total the days quoted and taken off.
    """
    quoted = [
        F.struct(F.lit(name).alias("policy"), F.col(column).cast("long").alias("days"))
        for name, column in policies.items()
    ]
    per_policy = F.explode(F.array(*quoted)).alias("quote")
    n, quote, current = F.col("n"), F.col("quote.days"), F.col("current_promise_days")
    long = cells.select(*keys, actual, current, n, per_policy)
    return long.groupBy(*keys, F.col("quote.policy").alias("policy")).agg(
        F.sum("n").alias("n_orders"),
        F.sum(F.when(quote.isNotNull(), n)).alias("judged"),
        F.sum(F.when(F.col(actual) <= quote, n).otherwise(0)).alias("on_time"),
        F.sum(quote * n).alias("promised"),
        F.sum((current - quote) * n).alias("saved"),
        F.sum(F.when((current - quote).isNotNull(), n)).alias("compared"),
    )


def policy_headline(cells: DataFrame, quoted: Mapping[str, str]) -> DataFrame:
    """Per policy: mean promise, mean days saved, share on time."""
    sums = evaluate_policies(cells, quoted).orderBy("policy")
    return sums.select(
        "policy",
        ratio(F.col("promised"), F.col("judged")).alias("mean_promise_days"),
        ratio(F.col("saved"), F.col("compared")).alias("mean_days_saved"),
        pct(F.col("on_time"), F.col("judged")).alias("pct_on_time"),
    )


def fallback_usage(cells: DataFrame) -> DataFrame:
    used = cells.groupBy("promise_source").agg(F.sum("n").alias("n_orders"))
    return share_of_total(used, "n_orders", "pct").orderBy("promise_source")


def lane_service(cells: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """One row per lane of the lane tier: orders, promised days, on-time percentages.

    ``ot_<quantile>`` for every quantile; ``recal`` columns quote the highest one.
    """
    fractions = checked(fractions)
    n, actual = F.col("n"), F.col("total_days")
    now, top = F.col("current_promise_days"), F.col(new_name(fractions[-1]))
    known = F.sum(F.when(now.isNotNull(), n))

    def on_time(promise: Column) -> Column:
        return F.sum(F.when(actual <= promise, n).otherwise(0))

    return (
        cells.where(F.col("promise_source") == "1_lane")
        .groupBy("lane")
        .agg(
            F.sum("n").alias("n"),
            ratio(F.sum(now * n), known).alias("current_days"),
            ratio(F.sum(top * n), F.sum("n")).alias("recal_days"),
            ratio(F.sum((now - top) * n), known).alias("days_saved"),
            pct(on_time(now), known).alias("ot_current"),
            *[
                pct(on_time(F.col(new_name(f))), F.sum("n")).alias(f"ot_{mark(f)}")
                for f in fractions
            ],
        )
        .withColumn("ot_recal", F.col(f"ot_{mark(fractions[-1])}"))
    )


def lane_effect(lanes: DataFrame, k: int) -> DataFrame:
    return (
        lanes.orderBy(F.desc("n"), "lane")
        .limit(k)
        .select(
            "lane",
            F.col("n").alias("n_test"),
            "current_days",
            "recal_days",
            "days_saved",
            F.col("ot_current").alias("on_time_current"),
            F.col("ot_recal").alias("on_time_recal"),
        )
    )


def service_dispersion(
    lanes: DataFrame, min_orders: int, fractions: Sequence[float]
) -> DataFrame:
    """Worst, best, spread and deviation of lane on-time percentages, per policy."""
    shares = {"current": "ot_current"}
    shares |= {f"recal_p{mark(f)}": f"ot_{mark(f)}" for f in checked(fractions)}
    quoted = [F.struct(F.lit(p).alias("policy"), F.col(c).alias("ot")) for p, c in shares.items()]
    return (
        lanes.where(F.col("n") >= min_orders)
        .select(F.inline(F.array(*quoted)))
        .groupBy("policy")
        .agg(
            F.min("ot").alias("worst_lane"),
            F.max("ot").alias("best_lane"),
            (F.max("ot") - F.min("ot")).alias("spread"),
            F.stddev("ot").alias("stddev"),
        )
        .orderBy("policy")
    )


def regressed_lanes(lanes: DataFrame, min_orders: int) -> DataFrame:
    """Lanes that arrive on time less often under the highest promise, worst first."""
    return (
        lanes.where((F.col("n") >= min_orders) & (F.col("ot_recal") < F.col("ot_current")))
        .select("lane", "n", "ot_current", "ot_recal")
        .orderBy(F.col("ot_recal") - F.col("ot_current"), "lane")
    )


def worst_served(lanes: DataFrame, min_orders: int, k: int) -> DataFrame:
    return (
        lanes.where(F.col("n") >= min_orders)
        .orderBy(F.asc_nulls_last("ot_current"), "lane")
        .limit(k)
        .select("lane", "ot_current", "ot_recal")
    )
