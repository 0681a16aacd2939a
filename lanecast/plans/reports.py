"""Every report of the analysis by name: a function from marts to a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    GAP_BANDS,
    PROMISE_BANDS,
    REVIEW_BANDS,
    REVIEW_CHART_BANDS,
    band,
    exact_mean,
    pct,
    ratio,
)
from ..operators import calibration as cal
from ..operators import distribution as dist
from ..operators import lead_time, outcomes, quality, selection, sketches, star
from .marts import Marts, geo_in_days

Report = Callable[[Marts], DataFrame]
REPORTS: dict[str, Report] = {}
DERIVED: dict[str, Report] = {}


def report(fn: Report) -> Report:
    REPORTS[fn.__name__] = fn
    return fn


def derived(fn: Report) -> Report:
    """A figure worked out from other reports."""
    DERIVED[fn.__name__] = fn
    return fn


def _delivered(m: Marts) -> DataFrame:
    return m.sources.orders.where(F.col("order_status") == m.settings.status)


# Load check and profiling


@report
def load_check(m: Marts) -> DataFrame:
    return quality.load_summary(m.sources.order_headers, "order_id", "order_purchase_timestamp")


@report
def status_breakdown(m: Marts) -> DataFrame:
    return quality.category_counts(m.sources.order_headers, "order_status")


@report
def timestamp_completeness(m: Marts) -> DataFrame:
    return quality.completeness(
        _delivered(m),
        "delivered_orders",
        {
            "has_approved": "order_approved_at",
            "has_carrier": "order_delivered_carrier_date",
            "has_customer": "order_delivered_customer_date",
            "has_estimate": "order_estimated_delivery_date",
        },
    )


@report
def ordering_violations(m: Marts) -> DataFrame:
    return quality.order_violations(
        _delivered(m),
        [
            ("approved_before_purchase", "order_purchase_timestamp", "order_approved_at"),
            ("shipped_before_approved", "order_approved_at", "order_delivered_carrier_date"),
            (
                "delivered_before_shipped",
                "order_delivered_carrier_date",
                "order_delivered_customer_date",
            ),
        ],
    )


@report
def monthly_volume(m: Marts) -> DataFrame:
    return quality.monthly_volume(m.sources.order_headers, "order_purchase_timestamp")


@report
def violation_gap_summary(m: Marts) -> DataFrame:
    hours = F.col("hours_early")
    gaps = quality.carrier_before_approval(m.sources.orders, m.settings.status)
    return gaps.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"),
        F.min(hours).alias("min_hours"),
        dist.quantiles(hours, 0.5, 0.95).alias("q"),
        F.max(hours).alias("max_hours"),
    ).select(
        "n_orders",
        "min_hours",
        F.col("q")[0].alias("median_hours"),
        F.col("q")[1].alias("p95_hours"),
        "max_hours",
    )


@report
def violation_gap_buckets(m: Marts) -> DataFrame:
    gaps = quality.carrier_before_approval(m.sources.orders, m.settings.status)
    return (
        gaps.groupBy(band("hours_early", GAP_BANDS).alias("gap_bucket"))
        .agg(F.sum("n").alias("n_orders"))
        .orderBy("gap_bucket")
    )


@report
def violation_vs_clean(m: Marts) -> DataFrame:
    total = F.col("total_days")
    groups = quality.violation_groups(m.sources.orders, m.settings.status)
    return groups.groupBy("grp").agg(
        F.sum("n").alias("n_orders"),
        dist.quantiles(total, 0.5, 0.95).alias("q"),
    ).select(
        "grp",
        "n_orders",
        F.col("q")[0].alias("median_total_days"),
        F.col("q")[1].alias("p95_total_days"),
    )


@report
def category_mix(m: Marts) -> DataFrame:
    src = m.sources
    return outcomes.category_mix(
        src.items, src.products, src.translation, m.settings.top_categories
    )


# Base table and promise error


@report
def orders_base(m: Marts) -> DataFrame:
    return m.base


@report
def base_funnel(m: Marts) -> DataFrame:
    stages = {
        "all orders": F.lit(True),
        "delivered": F.col("order_status") == m.settings.status,
        "final base": lead_time.in_base(m.settings),
    }
    return quality.funnel(m.sources.orders, stages)


@report
def base_headline(m: Marts) -> DataFrame:
    return lead_time.headline(m.base)


@report
def promise_error_percentiles(m: Marts) -> DataFrame:
    return lead_time.promise_error_percentiles(m.base)


@report
def promise_error_bands(m: Marts) -> DataFrame:
    counts = dist.band_profile(m.base, "promise_error_days", PROMISE_BANDS)
    return dist.share_of_total(counts, "n_orders", "pct").orderBy("bucket")


# Lead-time segments


@report
def orders_segments(m: Marts) -> DataFrame:
    return m.segment_days


@report
def segment_distributions(m: Marts) -> DataFrame:
    return lead_time.segment_distributions(m.segments)


@report
def segment_share(m: Marts) -> DataFrame:
    return lead_time.segment_share(m.segments)


@report
def segments_by_lateness(m: Marts) -> DataFrame:
    return lead_time.segments_by_lateness(m.segments)


@report
def segment_sum_check(m: Marts) -> DataFrame:
    return lead_time.segment_sum_check(m.segments)


# Geography and variance


@report
def orders_geo(m: Marts) -> DataFrame:
    return geo_in_days(m.geo)


@report
def geo_join_check(m: Marts) -> DataFrame:
    return quality.completeness(m.geo, "n_rows", {"has_state": "customer_state"}).withColumn(
        "missing_state", F.col("n_rows") - F.col("has_state")
    )


@report
def state_transit_top15(m: Marts) -> DataFrame:
    places = star.place_profile(m.geo, "customer_state")
    return star.largest(places, "customer_state", m.settings.top_states)


@report
def fastest_slowest_states(m: Marts) -> DataFrame:
    s = m.settings
    return star.fastest_and_slowest(m.geo, "customer_state", s.min_state_orders, s.extreme_states)


@report
def variance_by_state(m: Marts) -> DataFrame:
    spread = dist.variance_explained(m.geo, "transit_hours", {"state": "customer_state"})
    total, within = F.col("total_variance"), F.col("within_state")
    return spread.select(
        (total / 576).alias("total_variance"),
        (within / 576).alias("within_state_variance"),
        (100 * (1 - ratio(within, total))).alias("pct_explained_by_state"),
    )


# Seller multiplicity


@report
def order_seller_profile(m: Marts) -> DataFrame:
    return m.base_profile


@report
def items_coverage(m: Marts) -> DataFrame:
    return star.items_coverage(m.base, m.sources.items)


@report
def sellers_per_order(m: Marts) -> DataFrame:
    return star.size_histogram(m.base_profile, "n_sellers")


@report
def seller_states_per_order(m: Marts) -> DataFrame:
    return star.size_histogram(m.base_profile, "n_seller_states")


@report
def multi_seller_effect(m: Marts) -> DataFrame:
    return star.multi_seller_effect(m.segments, m.profile)


# Star schema


@report
def dim_customer_geo(m: Marts) -> DataFrame:
    return star.customer_geo(m.sources.customers)


@report
def dim_seller_geo(m: Marts) -> DataFrame:
    return star.seller_geo(m.sources.sellers)


@report
def order_origin(m: Marts) -> DataFrame:
    return m.profile.select("order_id", "seller_id", "n_sellers", "n_seller_states")


@report
def fct_orders(m: Marts) -> DataFrame:
    return lead_time.segments_in_days(m.fact)


@report
def fact_integrity(m: Marts) -> DataFrame:
    missing = {"null_cust_state": "customer_state", "null_sell_state": "seller_state"}
    return star.join_integrity(m.base, m.fact, "order_id", missing)


@report
def lane_coverage(m: Marts) -> DataFrame:
    return star.lane_coverage(m.fact)


@report
def top_lanes(m: Marts) -> DataFrame:
    lanes = star.place_profile(lead_time.trusted(m.fact), "lane")
    return star.largest(lanes, "lane", m.settings.top_lanes)


@report
def variance_dest_vs_lane(m: Marts) -> DataFrame:
    spread = dist.variance_explained(
        lead_time.trusted(m.fact), "transit_hours", {"dest": "customer_state", "lane": "lane"}
    )
    total = F.col("total_variance")
    return spread.select(
        (total / 576).alias("total_variance"),
        (100 * (1 - ratio(F.col("within_dest"), total))).alias("pct_explained_dest_only"),
        (100 * (1 - ratio(F.col("within_lane"), total))).alias("pct_explained_full_lane"),
    )


# Recalibration


@report
def train_test_split(m: Marts) -> DataFrame:
    return cal.temporal_split(m.fact_orders, m.settings.train_end)


@report
def lane_threshold_coverage(m: Marts) -> DataFrame:
    s = m.settings
    return cal.threshold_coverage(m.fact, s.train_end, s.coverage_thresholds)


def _history(m: Marts, orders: DataFrame) -> DataFrame:
    return orders.where(F.col("purchase_date") < F.lit(m.settings.train_end))


def _trained(m: Marts) -> Marts:
    """Marts whose scan ends with the training window."""
    return m.before(m.settings.train_end)


@report
def lane_promise(m: Marts) -> DataFrame:
    s = m.settings
    counted = cal.count_days(_history(m, _trained(m).fact), ["lane"])
    return cal.calibrate(counted, ["lane"], s.quantiles, s.min_lane_orders)


@report
def state_promise(m: Marts) -> DataFrame:
    placed = _history(m, _trained(m).fact_orders)
    if "customer_state" not in placed.columns:
        placed = star.join_customers(placed, m.sources.customers, ["customer_state"])
    counted = cal.count_days(placed, ["customer_state"])
    return cal.calibrate(counted, ["customer_state"], m.settings.quantiles)


@report
def national_promise(m: Marts) -> DataFrame:
    counted = cal.count_days(_history(m, _trained(m).fact_orders), [])
    return cal.calibrate(counted, [], m.settings.quantiles)


@report
def test_eval(m: Marts) -> DataFrame:
    return m.test_eval


@report
def fallback_usage(m: Marts) -> DataFrame:
    return cal.fallback_usage(m.evaluated_cells)


@report
def policy_headline(m: Marts) -> DataFrame:
    return cal.policy_headline(m.evaluated_cells, cal.policies(m.settings.quantiles))


@report
def lane_effect_p95(m: Marts) -> DataFrame:
    return cal.lane_effect(m.lanes, m.settings.top_lanes)


@report
def service_dispersion(m: Marts) -> DataFrame:
    s = m.settings
    return cal.service_dispersion(m.lanes, s.min_dispersion_orders, s.compared_quantiles)


# Outcome cost


@report
def order_outcomes(m: Marts) -> DataFrame:
    return m.outcomes


@report
def outcome_coverage(m: Marts) -> DataFrame:
    return quality.completeness(
        m.outcomes,
        "n_orders",
        {
            "has_review": "review_score",
            "has_value": "order_value",
            "has_customer": "customer_unique_id",
        },
    )


@report
def review_by_lateness(m: Marts) -> DataFrame:
    return outcomes.review_by_lateness(m.reviewed)


@report
def review_dose_response(m: Marts) -> DataFrame:
    rates = {
        "mean_score": exact_mean(F.col("review_score")),
        "pct_1_star": outcomes.star_shares()["pct_1_star"],
    }
    return outcomes.review_by_band(m.reviewed, REVIEW_BANDS, rates)


@report
def repeat_within_90d(m: Marts) -> DataFrame:
    return outcomes.repeat_rate(m.followups, "pct_repeat_90d")


@report
def revenue_exposure(m: Marts) -> DataFrame:
    return outcomes.revenue_exposure(m.valued)


# Data behind the figures


@report
def regressed_lanes(m: Marts) -> DataFrame:
    return cal.regressed_lanes(m.lanes, m.settings.min_measured_orders)


@report
def promise_error_histogram(m: Marts) -> DataFrame:
    """The figure's one-day bins, counted on the cluster; days without orders are zero."""
    low, high = m.settings.histogram_days
    found = (
        m.fact_orders.where(F.col("promise_error_days").between(low, high))
        .groupBy("promise_error_days")
        .agg(F.count("*").alias("n_orders"))
    )
    bins = found.sparkSession.range(low, high + 1)
    bins = bins.select(F.col("id").cast("int").alias("promise_error_days"))
    return bins.join(found, "promise_error_days", "left").fillna(0, ["n_orders"])


@report
def lateness_segment_medians(m: Marts) -> DataFrame:
    medians = lead_time.segments_by_lateness(m.fact_orders).drop("n_orders")
    return medians.orderBy("is_late")


@report
def lane_tail_vs_lateness(m: Marts) -> DataFrame:
    return star.lane_tails(m.fact, m.settings.min_tail_orders)


@report
def worst_served_lanes(m: Marts) -> DataFrame:
    s = m.settings
    return cal.worst_served(m.lanes, s.min_measured_orders, s.worst_lanes)


@report
def review_timing_bands(m: Marts) -> DataFrame:
    rates = {"mean_score": exact_mean(F.col("review_score"))}
    bands = outcomes.review_by_band(m.reviewed, REVIEW_CHART_BANDS, rates)
    return bands.drop("n_orders")


# Derived figures


@derived
def inclusion_funnel(m: Marts) -> DataFrame:
    """Orders kept and dropped at each step, then the lanes that can be priced and measured.

    Drops are told where a step narrows the one before: orders up to the base, lanes
    from priced to measured.
    """
    s = m.settings
    kept = quality.funnel(
        m.sources.orders,
        {
            "1 raw orders": F.lit(True),
            "2 delivered orders": F.col("order_status") == s.status,
            "3 analysis base": lead_time.in_base(s),
        },
    )
    trained = F.col("split") == cal.TRAIN
    per_lane = m.cells.groupBy("lane").agg(
        F.sum(F.when(trained, F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(trained, 0).otherwise(F.col("n"))).alias("n_test"),
    )
    known = F.col("lane").isNotNull()
    priced = known & (F.col("n_train") >= s.min_lane_orders)
    measured = priced & (F.col("n_test") >= s.min_measured_orders)
    lanes = per_lane.agg(
        F.sum("n_test").alias("4 test orders"),
        F.count_if(priced).alias("5 lanes with history"),
        F.count_if(measured).alias("6 measurable lanes"),
    )
    steps = kept.unionByName(lanes.unpivot([], lanes.columns, "stage", "n"))
    before = F.lag("n").over(dist.Window.orderBy("stage"))
    narrows = F.substring("stage", 1, 1).isin("2", "3", "6")
    return steps.withColumn("dropped", F.when(narrows, before - F.col("n")))


@derived
def tail_lateness_correlation(m: Marts) -> DataFrame:
    """How lane lateness moves with unpredictability and with distance."""
    tails = star.lane_tails(m.fact, m.settings.min_tail_orders)
    return tails.agg(
        F.count("*").alias("n_lanes"),
        F.corr("pct_late", "tail_spread").alias("corr_tail_spread"),
        F.corr("pct_late", "median_transit").alias("corr_median_transit"),
    )


@derived
def late_rate_reduction(m: Marts) -> DataFrame:
    """Late rate per policy and its change against the current one."""
    quoted = cal.policies(m.settings.quantiles)
    late = cal.evaluate_policies(m.evaluated_cells, quoted).select(
        "policy", (F.col("judged") - F.col("on_time")).alias("late"), "judged"
    )
    pct_late = pct(F.col("late"), F.col("judged"))
    rates = late.select("policy", pct_late.alias("pct_late"))
    return _against_current(rates, "pct_late", "pct_change")


@derived
def dispersion_reduction(m: Marts) -> DataFrame:
    """Deviation of lane service per policy and its change against the current one."""
    s = m.settings
    spread = cal.service_dispersion(m.lanes, s.min_measured_orders, s.compared_quantiles)
    return _against_current(spread.select("policy", "stddev"), "stddev", "pct_change")


def _against_current(df: DataFrame, value: str, name: str) -> DataFrame:
    everything = dist.Window.partitionBy()
    current = F.max(F.when(F.col("policy") == "current", F.col(value))).over(everything)
    return df.withColumn(name, pct(F.col(value) - current, current))


@derived
def regression_summary(m: Marts) -> DataFrame:
    """How many measurable lanes lost service, by how much, and from where."""
    measured = m.lanes.where(F.col("n") >= m.settings.min_measured_orders)
    worse = F.col("ot_recal") < F.col("ot_current")
    return measured.agg(
        F.count("*").alias("n_lanes"),
        F.count_if(worse).alias("n_regressed"),
        pct(F.count_if(worse), F.count("*")).alias("pct_regressed"),
        F.avg(F.when(worse, F.col("ot_recal") - F.col("ot_current"))).alias("mean_change"),
        F.min(F.when(worse, F.col("ot_current"))).alias("min_before"),
        F.min(F.when(worse, F.col("ot_recal"))).alias("min_after"),
    )


@derived
def late_to_ontime_conversion(m: Marts) -> DataFrame:
    """Orders the highest promise turns on time over the lowest, and the one-star reviews that saves."""
    low, *_, high = cal.checked(m.settings.quantiles) * 2
    missed = F.col("total_days") > F.col(cal.new_name(low))
    met = F.col("total_days") <= F.col(cal.new_name(high))
    converted = m.evaluated_cells.agg(
        F.sum(F.when(missed & met, F.col("n")).otherwise(0)).alias("converted_orders")
    )
    stars = outcomes.review_by_lateness(m.reviewed).agg(
        F.max(F.when(F.col("is_late"), F.col("pct_1_star"))).alias("late"),
        F.max(F.when(~F.col("is_late"), F.col("pct_1_star"))).alias("on_time"),
    )
    gap = stars.select(F.col("late") - F.col("on_time")).scalar()
    return converted.select(
        "converted_orders",
        gap.alias("one_star_gap"),
        (F.col("converted_orders") * gap / 100).alias("one_star_reviews_avoided"),
    )


@derived
def order_value_quantiles(m: Marts) -> DataFrame:
    """What late and on-time orders are worth: exact quantiles of a continuous amount."""
    marks = {"median_value": 0.5, "p90_value": 0.9, "p95_value": 0.95, "p99_value": 0.99}
    found = selection.exact_quantiles(m.valued, "order_value", marks, ["is_late"])
    return found.withColumnsRenamed({"n": "n_orders", "mean": "mean_value"}).orderBy("is_late")


@derived
def lane_promise_sketched(m: Marts) -> DataFrame:
    """Lane promises from mergeable daily sketches; lanes of up to ``SKETCH_SIZE`` orders are exact."""
    s = m.settings
    days = sketches.day_sketches(_history(m, _trained(m).fact), ["lane"])
    return sketches.calibrate_sketched(days, ["lane"], s.quantiles, end=s.train_end, min_orders=s.min_lane_orders)


@derived
def lane_coverage_curve(m: Marts) -> DataFrame:
    """``lane_threshold_coverage`` at every history that a lane has."""
    return cal.threshold_coverage(m.fact, m.settings.train_end)


@derived
def variance_by_key_set(m: Marts) -> DataFrame:
    """How much of the transit time's variance places and months explain, alone and together."""
    placed = lead_time.trusted(m.fact).withColumn("purchase_month", F.date_format("purchase_date", "yyyy-MM"))
    sets = {
        "destination": ["customer_state"],
        "origin": ["seller_state"],
        "lane": ["lane"],
        "destination_and_month": ["customer_state", "purchase_month"],
    }
    spread = dist.variance_explained(placed, "transit_hours", sets)
    total = F.col("total_variance")
    rows = [
        F.struct(F.lit(name).alias("key_set"), F.col(f"within_{name}").alias("within")) for name in sets
    ]
    return spread.select("n_orders", total, F.inline(F.array(*rows))).select(
        "key_set",
        "n_orders",
        (F.col("within") / 576).alias("within_variance"),
        (100 * (1 - ratio(F.col("within"), total))).alias("pct_explained"),
    ).orderBy("key_set")


@derived
def order_key_audit(m: Marts) -> DataFrame:
    """Which orders the joins of the fact lost, doubled or fanned out, and how many."""
    faults = star.integrity_keys(m.base, m.fact, "order_id", 5)
    return faults.select("kind", "n_keys", "n_rows", F.concat_ws(",", F.col("keys").cast("array<string>")).alias("first_keys"))


@derived
def step_chain(m: Marts) -> DataFrame:
    """Time between any two steps that follow each other, from order events with gaps."""
    chain = {
        "purchased": "purchased_at", "approved": "approved_at", "shipped": "shipped_at",
        "promised": "promised_at", "delivered": "delivered_at",
    }
    hours = lead_time.chain_segments(lead_time.base_events(m.base, chain), list(chain), "hour")
    return hours.groupBy("from_step", "to_step", "n_skipped").agg(
        F.count("*").alias("n_orders"),
        ratio(F.sum("length"), F.count("*")).alias("mean_hours"),
        F.min("length").alias("min_hours"),
        F.max("length").alias("max_hours"),
    )


@derived
def repeat_by_frame(m: Marts) -> DataFrame:
    """``repeat_within_90d`` by a range frame, without joining people to their orders."""
    s, src, person = m.settings, m.sources, "customer_unique_id"
    people = outcomes.with_person(m.fact_orders, src.customers)
    followups = outcomes.followup_by_frame(
        outcomes.first_orders(people, person),
        outcomes.order_days(src.order_headers, src.customers, person),
        person,
        s.repeat_days,
        s.repeat_until,
    )
    return outcomes.repeat_rate(followups, "pct_repeat_90d")
