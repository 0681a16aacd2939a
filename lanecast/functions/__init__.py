from .bands import (
    GAP_BANDS,
    PROMISE_BANDS,
    REVIEW_BANDS,
    REVIEW_CHART_BANDS,
    Band,
    band,
)
from .numbers import days, exact_mean, pct, ratio, shown
from .timecalc import day_diff, hour_boundaries, latest_first, month_label

__all__ = [
    "Band",
    "GAP_BANDS",
    "PROMISE_BANDS",
    "REVIEW_BANDS",
    "REVIEW_CHART_BANDS",
    "band",
    "day_diff",
    "days",
    "exact_mean",
    "hour_boundaries",
    "latest_first",
    "month_label",
    "pct",
    "ratio",
    "shown",
]
