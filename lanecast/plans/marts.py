"""The tables between the sources and the reports, built lazily and once each."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import days, month_label
from ..operators import calibration, lead_time, outcomes, star
from ..session import delete_folder, freeze
from ..settings import MARKETPLACE, Settings
from ..sources import Sources
from .snapshots import Snapshots


class Marts:
    """Lineage of the analysis over one set of sources.

    Tables are frames, built on first use.  With ``store`` (a folder on shared
    storage) the shared intermediates are written there, under this run's own id, and
    read back, so a batch of reports computes each once and runs do not touch each
    other; ``close`` deletes them.  Without it only the calibration tables are written:
    they are small and feed every calibration report several times.  Written tables
    make building a frame run jobs; all others are lazy.
    """

    # Names of the published tables.
    TABLES = (
        "orders_base",
        "orders_segments",
        "orders_geo",
        "order_seller_profile",
        "dim_customer_geo",
        "dim_seller_geo",
        "order_origin",
        "fct_orders",
        "lane_promise",
        "state_promise",
        "national_promise",
        "test_eval",
        "order_outcomes",
    )

    def __init__(
        self, sources: Sources, settings: Settings = MARKETPLACE, store: str | None = None
    ):
        self.sources = sources
        self.settings = settings
        self.store = store.rstrip("/") if store else None
        self.run_id = uuid.uuid4().hex
        self._written: SparkSession | None = None

    def _kept(self, name: str, df: DataFrame, always: bool = False) -> DataFrame:
        """``df`` from the store; without one as it is, or frozen if ``always``."""
        if self.store is None:
            return freeze(df, name) if always else df
        path = f"{self.store}/work/{self.run_id}/{name}"
        self._written = df.sparkSession
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete this run's intermediates from the store."""
        if self._written is not None:
            delete_folder(self._written, f"{self.store}/work/{self.run_id}")

    @cached_property
    def base(self) -> DataFrame:
        return lead_time.build_base(self.sources.orders, self.settings)

    @cached_property
    def segments(self) -> DataFrame:
        """Base rows with whole-hour segments; one narrow step over the orders."""
        return self._kept("segments", lead_time.with_segments(self.base))

    @cached_property
    def segment_days(self) -> DataFrame:
        kept = [
            "order_id", "purchased_at", "total_days", "promise_error_days",
            "is_late", "approval_suspect", *lead_time.SEGMENT_HOURS,
        ]
        return lead_time.segments_in_days(self.segments.select(kept))

    @cached_property
    def profile(self) -> DataFrame:
        """Every order with items: origin seller, items, sellers, seller states."""
        src = self.sources
        return self._kept("profile", star.order_sellers(src.items, src.sellers, src.bucketed))

    @cached_property
    def base_profile(self) -> DataFrame:
        """Seller counts of base orders that have items."""
        counts = self.profile.select("order_id", "n_items", "n_sellers", "n_seller_states")
        return self.segments.select("order_id").join(counts, "order_id")

    @cached_property
    def fact(self) -> DataFrame:
        """The fact with whole-hour segments."""
        fact = star.build_fact(self.segments, self.profile, self.sources.customers)
        return self._kept("fact", fact)

    @cached_property
    def geo(self) -> DataFrame:
        """Trusted base rows with the customer's state, in whole hours."""
        placed = star.join_customers(
            lead_time.trusted(self.segments), self.sources.customers, ["customer_state"]
        )
        return placed.select(
            "order_id",
            "total_days",
            "transit_hours",
            "handoff_hours",
            "promise_error_days",
            "is_late",
            "customer_state",
        )

    @cached_property
    def cells(self) -> DataFrame:
        counted = calibration.promise_cells(self.fact, self.settings.train_end)
        return self._kept("promise_cells", counted, always=True)

    def promises(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Lane, state and national promises from training orders only."""
        s = self.settings
        train = calibration.side(self.cells, calibration.TRAIN)
        return (
            calibration.calibrate(train, ["lane"], s.quantiles, s.min_lane_orders),
            calibration.calibrate(train, ["customer_state"], s.quantiles),
            calibration.calibrate(train, [], s.quantiles),
        )

    @cached_property
    def evaluated_cells(self) -> DataFrame:
        test = calibration.side(self.cells, calibration.TEST)
        return calibration.apply_promises(test, *self.promises(), self.settings.quantiles)

    @cached_property
    def lanes(self) -> DataFrame:
        """On-time service per lane of the lane tier, on the test orders."""
        return calibration.lane_service(self.evaluated_cells, self.settings.quantiles)

    @cached_property
    def test_eval(self) -> DataFrame:
        """One row per test order with every policy's promise.

        The only calibration table at order grain.  Training and test both read
        the fact, so its few columns are written once; the cells and the promise
        tables are written too, and their measured size decides how they join.
        """
        s = self.settings
        columns = [
            "order_id", "lane", "customer_state", "purchase_date",
            "total_days", "promise_error_days", "is_late",
        ]
        fact = self.fact.select(columns)
        if self.store is None:
            fact = freeze(fact, "fact_for_test")
            self.cells = freeze(calibration.promise_cells(fact, s.train_end), "promise_cells")
        lane, state, national = self.promises()
        judged = calibration.apply_promises(
            fact.where(F.col("purchase_date") >= F.lit(s.train_end)),
            self._kept("lane_promise", lane, always=True),
            self._kept("state_promise", state, always=True),
            national,
            s.quantiles,
        )
        new = [calibration.new_name(q) for q in calibration.checked(s.quantiles)]
        return judged.select(
            "order_id", "lane", "customer_state", "total_days", "is_late",
            "current_promise_days", *new, "promise_source",
        )

    @cached_property
    def fact_orders(self) -> DataFrame:
        """The fact's orders: the stored fact, or without a store one join without places."""
        if self.store is not None:
            return self.fact
        return star.fact_orders(self.segments, self.sources.items)

    @cached_property
    def outcomes(self) -> DataFrame:
        src = self.sources
        return outcomes.attach_outcomes(
            self.fact_orders, src.customers, src.reviews, src.payments
        )

    @cached_property
    def reviewed(self) -> DataFrame:
        return self._kept("reviewed", outcomes.with_review(self.fact_orders, self.sources.reviews))

    @cached_property
    def valued(self) -> DataFrame:
        return outcomes.with_value(self.fact_orders, self.sources.payments)

    @cached_property
    def followups(self) -> DataFrame:
        s, src, person = self.settings, self.sources, "customer_unique_id"
        people = outcomes.with_person(self.fact_orders, src.customers)
        return outcomes.followup_within(
            outcomes.first_orders(people, person),
            outcomes.order_days(src.order_headers, src.customers, person),
            person,
            s.repeat_days,
            s.repeat_until,
        )

    def tables(self) -> dict[str, DataFrame]:
        """The published tables, in the public column layout."""
        lane, state, national = self.promises()
        frames = (
            self.segments.drop(*lead_time.SEGMENT_HOURS),
            self.segment_days,
            geo_in_days(self.geo),
            self.base_profile,
            star.customer_geo(self.sources.customers),
            star.seller_geo(self.sources.sellers),
            self.profile.select("order_id", "seller_id", "n_sellers", "n_seller_states"),
            lead_time.segments_in_days(self.fact),
            lane,
            state,
            national,
            self.test_eval,
            self.outcomes,
        )
        return dict(zip(self.TABLES, frames, strict=True))

    def publish(self, folder: str) -> int:
        """Check the fact's grain, write every table, then switch readers over; the version.

        Tables with a purchase date are partitioned by its month; ``rebalance``
        splits a month that holds most rows and merges the small ones.  A run that
        fails leaves the published set as it was.
        """
        star.require_integrity(self.segments, self.fact, "order_id")
        snapshots = Snapshots(self.segments.sparkSession, folder)
        run, schemas = snapshots.begin(), {}
        for name, df in self.tables().items():
            target = snapshots.place(run, name)
            if "purchase_date" in df.columns:
                df = df.withColumn("purchase_month", month_label("purchase_date"))
                df = df.hint("rebalance", "purchase_month")
                df.write.partitionBy("purchase_month").parquet(target)
            else:
                df.write.parquet(target)
            schemas[name] = df.schema
        return snapshots.commit(run, schemas)

    def before(self, cutoff: date) -> Marts:
        """Marts of the orders bought before a date, whose scan skips the months after it.

        With a store the tables are shared already, so the same marts are returned.
        """
        end = min(self.settings.window_end, datetime.combine(cutoff, datetime.min.time()))
        if self.store is not None or end == self.settings.window_end:
            return self
        return Marts(self.sources, replace(self.settings, window_end=end))


def geo_in_days(geo: DataFrame) -> DataFrame:
    return geo.select(
        "order_id",
        "total_days",
        days(F.col("transit_hours")).alias("transit_days"),
        days(F.col("handoff_hours")).alias("handoff_days"),
        "promise_error_days",
        "is_late",
        "customer_state",
    )


def read_table(
    spark: SparkSession, folder: str, name: str, version: int | None = None
) -> DataFrame:
    """A published table without its partition column, by default of the newest version.

    Readers of several tables that must fit together pass one version of
    ``Snapshots(spark, folder).versions()`` to all of them.
    """
    return Snapshots(spark, folder).read(name, version).drop("purchase_month")
