"""Origin assignment, seller profiles, and the one-row-per-order fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import days, latest_first, pct
from .distribution import quantiles, rows_of, share_of_total, value_counts, value_of
from .lead_time import trusted

LANE_ARROW = " -> "


def customer_geo(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "customer_state", "customer_city", "customer_zip_code_prefix"
    )


def seller_geo(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", "seller_state", "seller_city", "seller_zip_code_prefix")


def order_sellers(items: DataFrame, sellers: DataFrame, bucketed: bool = False) -> DataFrame:
    """Per order: items, sellers, seller states, and the origin seller.

    The origin is the seller of the latest shipping limit (lowest id on ties,
    missing limits last).  Items first collapse to one row per order and seller,
    combined before they move, so an order of any size shrinks to at most as many
    rows as there are sellers.  The seller table is joined once, at that grain.
    One shuffle by order then serves all counts and the join with the orders;
    those rows hardly combine further, so it is asked for before the aggregate.
    Items bucketed by order need no shuffle at all.
    """
    pairs = items.groupBy("order_id", "seller_id").agg(
        F.max("shipping_limit_date").alias("limit"), F.count("*").alias("n_items")
    )
    placed = pairs.join(sellers.select("seller_id", "seller_state"), "seller_id", "left")
    if not bucketed:
        placed = placed.repartition("order_id")
    # Structs put NULLs first; a missing seller must lose a tie.
    nameless = F.col("seller_id").isNull()
    latest = F.min(F.struct(latest_first(F.col("limit")), nameless, "seller_id", "seller_state"))
    return (
        placed.groupBy("order_id")
        .agg(
            latest.alias("origin"),
            F.sum("n_items").alias("n_items"),
            F.count("seller_id").alias("n_sellers"),
            F.count_distinct("seller_state").alias("n_seller_states"),
        )
        .select(
            "order_id",
            F.col("origin.seller_id").alias("seller_id"),
            F.col("origin.seller_state").alias("seller_state"),
            "n_items",
            "n_sellers",
            "n_seller_states",
        )
    )


def join_customers(df: DataFrame, customers: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.join(customers.select("customer_id", *columns), "customer_id", "left")


def item_counts(items: DataFrame) -> DataFrame:
    """Items per order; all that reports need which ignore the origin."""
    return items.groupBy("order_id").agg(F.count("*").alias("n_items"))


def build_fact(
    segments: DataFrame,
    profile: DataFrame,
    customers: DataFrame,
    arrow: str = LANE_ARROW,
) -> DataFrame:
    """The fact table: states are stored on it so that reports need no more joins.

    Orders without items drop out at the join with their origin.  Lane and
    intrastate flag are NULL when either state is.
    """
    shipped = segments.join(profile.drop("n_items"), "order_id")
    placed = join_customers(shipped, customers, ["customer_state"])
    origin, destination = F.col("seller_state"), F.col("customer_state")
    return placed.select(
        "order_id",
        "customer_id",
        "seller_id",
        F.to_date("purchased_at").alias("purchase_date"),
        "customer_state",
        "seller_state",
        F.concat(origin, F.lit(arrow), destination).alias("lane"),
        (origin == destination).alias("is_intrastate"),
        "total_days",
        "approval_hours",
        "handoff_hours",
        "transit_hours",
        "promise_error_days",
        "is_late",
        "approval_suspect",
        "n_sellers",
        "n_seller_states",
        (F.col("n_seller_states") > 1).alias("origin_ambiguous"),
    )


def fact_orders(segments: DataFrame, items: DataFrame) -> DataFrame:
    """The fact's rows for reports that need neither origin nor lane."""
    placed = segments.join(item_counts(items), "order_id")
    return placed.withColumn("purchase_date", F.to_date("purchased_at"))


def join_integrity(
    base: DataFrame, fact: DataFrame, key: str, lookups: Mapping[str, str]
) -> DataFrame:
    """Rows before and after the joins, distinct keys, and missing lookups.

    ``lookups`` maps an output name to the column whose NULLs it counts.
    """
    base_rows = base.agg(F.count("*")).scalar()
    return fact.agg(
        F.count("*").alias("fact_rows"),
        F.count_distinct(key).alias("distinct_orders"),
        *[F.count_if(F.col(c).isNull()).alias(name) for name, c in lookups.items()],
    ).select(base_rows.alias("base_rows"), "*")


# Kinds of keys that an integrity audit names.
LOST, FOREIGN, DOUBLED, FANNED_OUT = "lost", "foreign", "doubled", "fanned_out"


def integrity_keys(base: DataFrame, fact: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Per kind of fault: ``n_keys``, ``n_rows`` and the first ``most`` keys (NULL first).

    ``lost`` keys are missing from the fact, ``foreign`` ones from the base; ``doubled``
    keys stand in the base several times; ``fanned_out`` keys have more fact rows than base
    rows.  A key may have several faults.  Rows are counted by key on both sides, so a
    key with any number of rows moves as one; the counts are joined once, full outer.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias(f"{name}_key")).agg(F.count("*").alias(name))

    before, after = counted(base, "before"), counted(fact, "after")
    both = before.join(after, F.col("before_key").eqNullSafe(F.col("after_key")), "full_outer")
    faults = {
        LOST: F.col("after").isNull(),
        FOREIGN: F.col("before").isNull(),
        DOUBLED: F.col("before") > 1,
        FANNED_OUT: F.col("after") > F.col("before"),
    }
    kinds = F.array(*[F.when(c, F.lit(kind)) for kind, c in faults.items()])
    rows = F.greatest(F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0)))
    found = both.where(F.array_size(F.array_compact(kinds)) > 0).select(
        F.when(F.col("before").isNull(), F.col("after_key")).otherwise(F.col("before_key")).alias("key"),
        rows.alias("rows"),
        F.explode(F.array_compact(kinds)).alias("kind"),
    )
    totals = found.groupBy("kind").agg(F.count("*").alias("n_keys"), F.sum("rows").alias("n_rows"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.asc_nulls_first("key")))
    first = found.withColumn("place", place).where(F.col("place") <= most)
    listed = first.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("l"))
    return totals.join(listed.select("kind", F.col("l.key").alias("keys")), "kind").orderBy("kind")


def require_integrity(base: DataFrame, fact: DataFrame, key: str) -> None:
    """Raise when the joins duplicated rows, naming keys; run before building on a new fact.

    Counts come first; the keys are looked for only where those fail.
    """
    check = join_integrity(base, fact, key, {}).first()
    if check.fact_rows != check.distinct_orders or check.fact_rows > check.base_rows:
        faults = integrity_keys(base, fact, key).where(F.col("kind") != LOST).collect()
        told = "; ".join(f"{r['kind']}: {r['n_keys']} keys, first {r['keys']}" for r in faults)
        raise ValueError(f"fact does not hold one row per order: {check.asDict()}; {told}")


def items_coverage(base: DataFrame, items: DataFrame) -> DataFrame:
    """Base orders with and without items, from one join."""
    matched = base.select("order_id").join(item_counts(items), "order_id", "left")
    return matched.agg(
        F.count("*").alias("orders_in_base"),
        F.count("n_items").alias("orders_with_items"),
        F.count_if(F.col("n_items").isNull()).alias("orders_missing_items"),
    )


def size_histogram(profile: DataFrame, column: str) -> DataFrame:
    counts = profile.groupBy(column).agg(F.count("*").alias("n_orders"))
    return share_of_total(counts, "n_orders", "pct").orderBy(column)


def multi_seller_effect(segments: DataFrame, profile: DataFrame) -> DataFrame:
    kind = F.when(F.col("n_sellers") == 1, "single seller").otherwise("multi seller")
    joined = trusted(segments).join(profile.select("order_id", "n_sellers"), "order_id")
    counted = value_counts(joined.withColumn("grp", kind), ["transit_hours"], ["grp"], "is_late")
    summed = counted.groupBy("grp").agg(
        F.sum("n").alias("n_orders"),
        quantiles(F.col("value"), 0.5, 0.95).alias("q"),
        pct(F.sum("n_flag"), F.sum("n_flag_known")).alias("pct_late"),
    )
    return summed.select("grp", "n_orders", *transit_columns(), "pct_late")


def transit_columns() -> list[Column]:
    """Median and p95 transit in days, from the hour quantiles in ``q``."""
    return [
        days(F.col("q")[0]).alias("median_transit"),
        days(F.col("q")[1]).alias("p95_transit"),
    ]


def place_profile(df: DataFrame, key: str) -> DataFrame:
    """Per place (state or lane): volume, transit, promise error, late share."""
    counted = value_counts(df, ["transit_hours", "promise_error_days"], [key], "is_late")
    transit, error = value_of("transit_hours"), value_of("promise_error_days")
    late = pct(rows_of("transit_hours", "n_flag"), rows_of("transit_hours", "n_flag_known"))
    summed = counted.groupBy(key).agg(
        rows_of("transit_hours").alias("n_orders"),
        quantiles(transit, 0.5, 0.95).alias("q"),
        quantiles(error, 0.5).alias("e"),
        late.alias("pct_late"),
    )
    median_error = F.col("e")[0].alias("median_promise_error")
    return summed.select(key, "n_orders", *transit_columns(), median_error, "pct_late")


def largest(df: DataFrame, key: str, k: int, volume: str = "n_orders") -> DataFrame:
    """Top k by volume; the key settles ties."""
    return df.orderBy(F.desc(volume), F.asc_nulls_last(key)).limit(k)


def fastest_and_slowest(df: DataFrame, key: str, min_orders: int, k: int) -> DataFrame:
    """The k fastest and k slowest places by median transit, from one aggregate."""
    counted = value_counts(df, ["transit_hours"], [key])
    places = (
        counted.groupBy(key)
        .agg(
            F.sum("n").alias("n_orders"),
            days(quantiles(F.col("value"), 0.5)[0]).alias("median_transit"),
        )
        .where(F.col("n_orders") >= min_orders)
    )
    ends = [
        places.orderBy(order("median_transit"), F.asc_nulls_last(key))
        .limit(k)
        .select(F.lit(name).alias("grp"), "*")
        for name, order in (("fastest", F.asc), ("slowest", F.desc))
    ]
    return ends[0].unionByName(ends[1]).orderBy("grp", "median_transit", key)


def lane_coverage(fact: DataFrame) -> DataFrame:
    """Lanes, intrastate share and ambiguous origins; distinct lanes from grouped rows."""
    per_lane = fact.groupBy("lane").agg(
        F.count_if("is_intrastate").alias("intrastate"),
        F.count("is_intrastate").alias("known"),
        F.count_if("origin_ambiguous").alias("ambiguous"),
    )
    return per_lane.agg(
        F.count("lane").alias("n_lanes"),
        F.sum("intrastate").alias("intrastate_orders"),
        pct(F.sum("intrastate"), F.sum("known")).alias("pct_intrastate"),
        F.sum("ambiguous").alias("ambiguous_origin_orders"),
    )


def lane_tails(fact: DataFrame, min_orders: int) -> DataFrame:
    """Per lane with enough orders: tail spread, late share and median transit."""
    counted = value_counts(trusted(fact), ["transit_hours"], ["lane"], "is_late")
    median, p95 = F.col("q")[0], F.col("q")[1]
    return (
        counted.groupBy("lane")
        .agg(
            F.sum("n").alias("n"),
            quantiles(F.col("value"), 0.5, 0.95).alias("q"),
            pct(F.sum("n_flag"), F.sum("n_flag_known")).alias("pct_late"),
        )
        .where(F.col("n") >= min_orders)
        .select(
            "lane",
            "n",
            days(p95 - median).alias("tail_spread"),
            "pct_late",
            days(median).alias("median_transit"),
        )
    )
