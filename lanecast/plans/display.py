"""Decimals of the printed figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shown

# Decimals per report and column; other columns print as they are.
PLACES: dict[str, dict[str, int]] = {
    "status_breakdown": {"pct": 2},
    "violation_vs_clean": {"median_total_days": 1, "p95_total_days": 1},
    "category_mix": {"avg_price_brl": 2, "avg_weight_kg": 2},
    "base_headline": {"mean_days": 1, "pct_late": 1, "mean_promise_error": 1},
    "promise_error_bands": {"pct": 1},
    "segment_distributions": {
        "mean_days": 2,
        "median_days": 2,
        "p95_days": 2,
        "stddev_days": 2,
        "tail_spread": 2,
    },
    "segment_share": {
        "approval": 2,
        "handoff": 2,
        "transit": 2,
        "pct_approval": 1,
        "pct_handoff": 1,
        "pct_transit": 1,
    },
    "segments_by_lateness": {"approval": 2, "handoff": 2, "transit": 2},
    "segment_sum_check": {"sum_of_segments": 3, "total_days_col": 3, "gap": 3},
    "state_transit_top15": {
        "median_transit": 1,
        "p95_transit": 1,
        "median_promise_error": 1,
        "pct_late": 1,
    },
    "variance_by_state": {
        "total_variance": 2,
        "within_state_variance": 2,
        "pct_explained_by_state": 1,
    },
    "sellers_per_order": {"pct": 2},
    "seller_states_per_order": {"pct": 2},
    "multi_seller_effect": {"median_transit": 1, "p95_transit": 1, "pct_late": 1},
    "lane_coverage": {"pct_intrastate": 1},
    "top_lanes": {
        "median_transit": 1,
        "p95_transit": 1,
        "median_promise_error": 1,
        "pct_late": 1,
    },
    "variance_dest_vs_lane": {
        "total_variance": 2,
        "pct_explained_dest_only": 1,
        "pct_explained_full_lane": 1,
    },
    "lane_threshold_coverage": {"pct_covered": 1},
    "fallback_usage": {"pct": 1},
    "policy_headline": {"mean_promise_days": 1, "mean_days_saved": 1, "pct_on_time": 1},
    "lane_effect_p95": {
        "current_days": 1,
        "recal_days": 1,
        "days_saved": 1,
        "on_time_current": 1,
        "on_time_recal": 1,
    },
    "service_dispersion": {"worst_lane": 1, "best_lane": 1, "spread": 1, "stddev": 2},
    "review_by_lateness": {"mean_score": 2, "pct_1_star": 1, "pct_1_or_2": 1, "pct_5_star": 1},
    "review_dose_response": {"mean_score": 2, "pct_1_star": 1},
    "repeat_within_90d": {"pct_repeat_90d": 2},
    "revenue_exposure": {"total_brl": 0, "mean_order_brl": 2, "pct_of_revenue": 1},
    "regressed_lanes": {"ot_current": 1, "ot_recal": 1},
}


def as_printed(name: str, df: DataFrame) -> DataFrame:
    """A report rounded the way it is published; apply it last."""
    places = PLACES.get(name, {})
    return df.select(
        [shown(F.col(c), places[c]).alias(c) if c in places else F.col(c) for c in df.columns]
    )
