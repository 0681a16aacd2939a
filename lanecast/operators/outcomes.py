"""What a late order costs: reviews, repeat purchases, revenue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import Band, exact_mean, pct, ratio
from . import star
from .distribution import band_profile, first_per_key, share_of_total

MONEY = "decimal(18,2)"


def latest_review(reviews: DataFrame) -> DataFrame:
    """One score per order: the latest review, the highest review id on ties."""
    newest = F.max(F.struct("review_creation_date", "review_id", "review_score"))
    return (
        reviews.groupBy("order_id")
        .agg(newest.alias("newest"))
        .select("order_id", F.col("newest.review_score").alias("review_score"))
    )


def order_value(payments: DataFrame) -> DataFrame:
    """Sum of payments per order, in exact money."""
    paid = F.sum(F.col("payment_value").cast(MONEY))
    return payments.groupBy("order_id").agg(paid.alias("order_value"))


def with_review(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    return orders.join(latest_review(reviews), "order_id", "left")


def with_value(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return orders.join(order_value(payments), "order_id", "left")


def with_person(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return star.join_customers(orders, customers, ["customer_unique_id"])


def attach_outcomes(
    orders: DataFrame, customers: DataFrame, reviews: DataFrame, payments: DataFrame
) -> DataFrame:
    """Fact orders with person, review and value.

    Reviews and payments shrink to one row per order first, and everything keyed
    by order is joined before the customers, so orders move at most twice.
    """
    by_order = with_value(with_review(orders, reviews), payments)
    return with_person(by_order, customers).select(
        "order_id",
        "customer_unique_id",
        "purchase_date",
        "total_days",
        "promise_error_days",
        "is_late",
        "review_score",
        "order_value",
    )


def share_where(condition: Column) -> Column:
    """Percent of rows with a known condition where it holds."""
    return pct(F.count_if(condition), F.count(condition))


# The score shares that the review reports show.
def star_shares() -> dict[str, Column]:
    score = F.col("review_score")
    return {
        "pct_1_star": share_where(score == 1),
        "pct_1_or_2": share_where(score <= 2),
        "pct_5_star": share_where(score == 5),
    }


def outcome_by(df: DataFrame, key: Column | str, rates: Mapping[str, Column]) -> DataFrame:
    """Rows and rates per group."""
    return df.groupBy(key).agg(
        F.count("*").alias("n_orders"), *[c.alias(name) for name, c in rates.items()]
    )


def review_by_lateness(outcomes: DataFrame) -> DataFrame:
    reviewed = outcomes.dropna(subset=["review_score"])
    rates = {"mean_score": exact_mean(F.col("review_score")), **star_shares()}
    return outcome_by(reviewed, "is_late", rates)


def review_by_band(
    outcomes: DataFrame, bands: Sequence[Band], rates: Mapping[str, Column]
) -> DataFrame:
    reviewed = outcomes.dropna(subset=["review_score"])
    return band_profile(reviewed, "promise_error_days", bands, rates).orderBy("bucket")


def first_orders(outcomes: DataFrame, key: str) -> DataFrame:
    """Each person's first order (lowest order id on a shared day)."""
    return first_per_key(
        outcomes, key, ["purchase_date", "order_id"], ["purchase_date", "is_late"]
    )


def order_days(headers: DataFrame, customers: DataFrame, key: str) -> DataFrame:
    """Orders of any status per person and day.

    Counted by customer record before the customers are joined and by person
    after, so someone with very many orders becomes one row per day.
    """
    per_record = headers.groupBy(
        "customer_id", F.to_date("order_purchase_timestamp").alias("day")
    ).agg(F.count("*").alias("n"))
    return (
        per_record.join(customers.select("customer_id", key), "customer_id")
        .groupBy(key, "day")
        .agg(F.sum("n").alias("n"))
    )


def followup_within(
    firsts: DataFrame,
    per_day: DataFrame,
    key: str,
    window_days: int,
    eligible_until: date,
) -> DataFrame:
    """Per eligible person: orders after the first day, up to ``window_days`` later."""
    first, day = F.col("purchase_date"), F.col("day")
    eligible = firsts.where(first <= F.lit(eligible_until))
    later = per_day.select(F.col(key).alias("_key"), "day", "n")
    inside = (
        (F.col(key) == F.col("_key"))
        & (day > first)
        & (day <= F.date_add(first, window_days))
    )
    return (
        eligible.join(later, inside, "left")
        .groupBy(key, "is_late")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_repeat"))
    )


def followup_by_frame(
    firsts: DataFrame,
    per_day: DataFrame,
    key: str,
    window_days: int,
    eligible_until: date,
) -> DataFrame:
    """``followup_within`` without a join: a RANGE frame over first orders and order days together.

    Both sides are dealt by person once and sorted by day; a person with any number of
    order days is read along once.  Rows of a person without an eligible first order
    are dropped after the frame.  NULL persons have no follow-ups, as in a join.
    """
    first = F.col("purchase_date")
    none = F.lit(None)
    both = firsts.where(first <= F.lit(eligible_until)).select(
        key, first.alias("day"), "is_late", F.lit(True).alias("starts"), F.lit(0).cast("long").alias("n")
    ).unionByName(
        per_day.select(
            key, "day", none.cast("boolean").alias("is_late"), F.lit(False).alias("starts"), F.col("n").cast("long")
        )
    )
    number = F.unix_date("day")
    ahead = Window.partitionBy(key).orderBy("number").rangeBetween(1, window_days)
    later = F.when(F.col(key).isNotNull(), F.coalesce(F.sum("n").over(ahead), F.lit(0))).otherwise(0)
    return (
        both.withColumn("number", number)
        .withColumn("n_repeat", later)
        .where("starts")
        .select(key, "is_late", "n_repeat")
    )


def repeat_rate(followups: DataFrame, name: str) -> DataFrame:
    again = F.count_if(F.col("n_repeat") > 0)
    return followups.groupBy("is_late").agg(
        F.count("*").alias("n_customers"), pct(again, F.count("*")).alias(name)
    )


def revenue_exposure(outcomes: DataFrame) -> DataFrame:
    paid = (
        outcomes.dropna(subset=["order_value"])
        .groupBy("is_late")
        .agg(F.count("*").alias("n_orders"), F.sum("order_value").alias("total"))
    )
    return share_of_total(paid, "total", "pct_of_revenue").select(
        "is_late",
        "n_orders",
        F.col("total").cast("double").alias("total_brl"),
        ratio(F.col("total"), F.col("n_orders")).alias("mean_order_brl"),
        "pct_of_revenue",
    )


def category_mix(
    items: DataFrame, products: DataFrame, translation: DataFrame, k: int
) -> DataFrame:
    """Top categories by items sold, with mean price and weight.

    Items are summed per product before the joins: a best seller is one row.
    """
    sold = items.groupBy("product_id").agg(
        F.count("*").alias("items"),
        F.count("price").alias("priced"),
        F.sum(F.col("price").cast(MONEY)).alias("paid"),
    )
    weight = F.col("product_weight_g")
    raw = (
        sold.join(
            products.select("product_id", "product_category_name", "product_weight_g"),
            "product_id",
            "left",
        )
        .groupBy("product_category_name")
        .agg(
            F.sum("items").alias("items"),
            F.sum("priced").alias("priced"),
            F.sum("paid").alias("paid"),
            F.sum(weight.cast(MONEY) * F.col("items")).alias("grams"),
            F.sum(F.when(weight.isNotNull(), F.col("items"))).alias("weighed"),
        )
    )
    named = raw.join(translation, "product_category_name", "left")
    category = F.coalesce(
        "product_category_name_english", "product_category_name", F.lit("unknown")
    )
    totals = named.groupBy(category.alias("category")).agg(
        F.sum("items").alias("items_sold"),
        ratio(F.sum("paid"), F.sum("priced")).alias("avg_price_brl"),
        (ratio(F.sum("grams"), F.sum("weighed")) / 1000.0).alias("avg_weight_kg"),
    )
    return totals.orderBy(F.desc("items_sold"), "category").limit(k)
