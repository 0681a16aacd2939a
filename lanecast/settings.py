"""Every constant of the analysis, as one value that callers can replace."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime


@dataclass(frozen=True)
class Settings:
    """Defaults are the marketplace study's fixed values."""

    status: str = "delivered"
    window_start: datetime = datetime(2017, 1, 1)
    window_end: datetime = datetime(2018, 9, 1)
    max_gap_hours: int = 168
    train_end: date = date(2018, 3, 1)
    quantiles: tuple[float, ...] = (0.90, 0.92, 0.95)
    # Of those, the ones whose spread across lanes is not reported.
    uncompared_quantiles: tuple[float, ...] = (0.92,)
    min_lane_orders: int = 100
    coverage_thresholds: tuple[int, ...] = (30, 50, 100, 200, 400)
    min_dispersion_orders: int = 50
    min_measured_orders: int = 100
    min_tail_orders: int = 150
    min_state_orders: int = 200
    repeat_days: int = 90
    repeat_until: date = date(2018, 6, 1)
    histogram_days: tuple[int, int] = (-45, 25)
    top_categories: int = 15
    top_states: int = 15
    top_lanes: int = 12
    extreme_states: int = 5
    worst_lanes: int = 20

    @property
    def compared_quantiles(self) -> tuple[float, ...]:
        return tuple(q for q in self.quantiles if q not in self.uncompared_quantiles)


MARKETPLACE = Settings()

# The TPC-H-like tables span other years and hold far fewer orders per lane,
# so only the calendar and the volume gates differ.
TPCH = Settings(
    window_start=datetime(1995, 7, 1),
    window_end=datetime(2001, 1, 1),
    train_end=date(1999, 7, 1),
    min_lane_orders=10,
    coverage_thresholds=(5, 10, 15, 20, 400),
    min_dispersion_orders=5,
    min_measured_orders=8,
    min_tail_orders=15,
    repeat_until=date(2000, 9, 1),
)
