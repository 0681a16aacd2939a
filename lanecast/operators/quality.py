"""Load checks and data-quality counts, each from one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_diff, hour_boundaries, month_label
from .distribution import share_of_total


def load_summary(orders: DataFrame, key: str, moment: str) -> DataFrame:
    """Rows, distinct keys, first and last moment."""
    return orders.agg(
        F.count("*").alias("total_rows"),
        F.count_distinct(key).alias("unique_orders"),
        F.min(moment).alias("earliest_purchase"),
        F.max(moment).alias("latest_purchase"),
    )


def category_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows and share of all rows per value, largest first."""
    counts = df.groupBy(key).agg(F.count("*").alias("n_orders"))
    return share_of_total(counts, "n_orders", "pct").orderBy(F.desc("n_orders"), key)


def completeness(df: DataFrame, total: str, columns: Mapping[str, str]) -> DataFrame:
    """Row count and, per output name, the non-null values of a column."""
    present = [F.count(column).alias(name) for name, column in columns.items()]
    return df.agg(F.count("*").alias(total), *present)


def order_violations(df: DataFrame, steps: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per (name, before, after): rows where ``after`` precedes ``before``."""
    return df.agg(
        *[F.count_if(F.col(after) < F.col(before)).alias(name) for name, before, after in steps]
    )


def funnel(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows that satisfy each stage's condition, as (stage, n), counted in one pass."""
    counted = df.agg(*[F.count_if(cond).alias(name) for name, cond in stages.items()])
    return counted.unpivot([], list(stages), "stage", "n")


def monthly_volume(df: DataFrame, moment: str) -> DataFrame:
    month = month_label(moment).alias("month")
    return df.groupBy(month).agg(F.count("*").alias("n_orders")).orderBy("month")


def carrier_before_approval(orders: DataFrame, status: str) -> DataFrame:
    """Hours by which the carrier scan precedes approval, as counted values."""
    early = F.col("order_delivered_carrier_date") < F.col("order_approved_at")
    gap = hour_boundaries("order_delivered_carrier_date", "order_approved_at")
    return (
        orders.where((F.col("order_status") == status) & early)
        .groupBy(gap.alias("hours_early"))
        .agg(F.count("*").alias("n"))
    )


def violation_groups(orders: DataFrame, status: str) -> DataFrame:
    """Counted total days of complete orders, split by whether the scan came too early."""
    times = [
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
    ]
    early = F.col("order_delivered_carrier_date") < F.col("order_approved_at")
    total = day_diff("order_purchase_timestamp", "order_delivered_customer_date")
    return (
        orders.where(F.col("order_status") == status)
        .dropna(subset=times)
        .groupBy(
            F.when(early, "violation").otherwise("clean").alias("grp"),
            total.alias("total_days"),
        )
        .agg(F.count("*").alias("n"))
    )
