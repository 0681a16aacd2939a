"""A stored fact and its promise cells, kept up to date from changed orders.

A change names orders; their rows are built again from the sources as they are now, and
no others.  What they were before is retracted: cells are counts, so a change is a set of
signed counts, the old rows' with minus and the new rows' with plus, added to the stored
ones.  The fact is stored by purchase month, and only the months that a changed order
was or is in are written anew; the manifest of a version names the run that holds
each month.  Versions are published whole (``snapshots``).
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import month_label
from ..operators import calibration, star
from ..session import freeze
from ..settings import Settings
from .marts import Marts
from .snapshots import Snapshots

CELL = ("split", "lane", "customer_state", "total_days", "promise_error_days")
FACT, CELLS = "fct_hours", "promise_cells"


def signed_cells(before: DataFrame, after: DataFrame, settings: Settings) -> DataFrame:
    """The change of the cells when fact rows ``before`` become ``after``: counts with a sign."""
    gone = calibration.promise_cells(before, settings.train_end).withColumn("n", -F.col("n"))
    new = calibration.promise_cells(after, settings.train_end)
    return gone.unionByName(new).groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def with_change(cells: DataFrame, change: DataFrame) -> DataFrame:
    """Cells after a change; a count below zero shows that the change does not fit them."""
    summed = cells.select(*CELL, "n").unionByName(change.select(*CELL, "n"))
    summed = summed.groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")
    wrong = F.raise_error(F.lit("a change retracts orders that the cells do not hold")).cast("long")
    return summed.withColumn("n", F.when(F.col("n") < 0, wrong).otherwise(F.col("n")))


class FactStore:
    """The fact (whole-hour segments) and the promise cells in a folder on shared storage."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings):
        self.spark, self.settings = spark, settings
        self.snapshots = Snapshots(spark, folder)

    def _write_fact(self, run: str, fact: DataFrame) -> list[str | None]:
        """Write rows by month; the months written."""
        target = self.snapshots.place(run, FACT)
        placed = fact.withColumn("purchase_month", month_label("purchase_date"))
        placed.hint("rebalance", "purchase_month").write.partitionBy("purchase_month").parquet(target)
        return self._months(self.spark.read.schema(placed.schema).parquet(target))

    @staticmethod
    def _months(fact: DataFrame) -> list[str]:
        return sorted(r[0] for r in fact.select("purchase_month").distinct().collect())

    def _commit(self, run: str, fact: DataFrame, cells: DataFrame, months: dict[str, str]) -> int:
        cells.write.parquet(self.snapshots.place(run, CELLS))
        return self.snapshots.commit(run, {FACT: fact.schema, CELLS: cells.schema}, {"months": months})

    def rebuild(self, sources) -> int:
        """Build everything from the sources; the version."""
        fact = Marts(sources, self.settings).fact
        star.require_integrity(fact, fact, "order_id")
        run = self.snapshots.begin()
        months = {m: run for m in self._write_fact(run, fact)}
        stored = self._read_months(fact.schema, months)
        return self._commit(run, fact, calibration.promise_cells(stored, self.settings.train_end), months)

    def _read_months(self, schema, months: dict[str, str]) -> DataFrame:
        """Fact rows of the months, each from the run that holds it."""
        whole = schema if "purchase_month" in schema.names else schema.add("purchase_month", "string")
        found = None
        for run in sorted(set(months.values())):
            own = [m for m, r in months.items() if r == run]
            part = self.spark.read.schema(whole).parquet(self.snapshots.place(run, FACT))
            part = part.where(F.col("purchase_month").isin(own)).drop("purchase_month")
            found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], whole).drop("purchase_month") if found is None else found

    def fact(self, version: int | None = None, months: list[str] | None = None) -> DataFrame:
        """The stored fact, or some months of it."""
        manifest = self.snapshots.manifest(version)
        held = manifest["extra"]["months"]
        chosen = held if months is None else {m: r for m, r in held.items() if m in set(months)}
        return self._read_months(self.snapshots.schema(FACT, manifest), chosen)

    def cells(self, version: int | None = None) -> DataFrame:
        return self.snapshots.read(CELLS, version)

    def apply(self, sources, touched: DataFrame) -> int:
        """Bring the store up to date for the orders in ``touched`` (order_id); the new version.

        ``sources`` are the sources as they are now.  An order that is new, changed in any of
        its rows, or gone must be named; one that is named without a change costs its own
        rows.  Sources are scanned once with a semi-join, and only named orders move.
        """
        manifest = self.snapshots.manifest()
        held = manifest["extra"]["months"]
        ids = freeze(touched.select("order_id").where("order_id IS NOT NULL").distinct(), "touched")
        narrow = SimpleNamespace(
            orders=sources.orders.join(ids, "order_id", "left_semi"),
            items=sources.items.join(ids, "order_id", "left_semi"),
            customers=sources.customers,
            sellers=sources.sellers,
            bucketed=False,
        )
        after = Marts(narrow, self.settings).fact
        schema = after.schema
        after = freeze(after, "rows-after")
        stored = self._read_months(schema, held)
        before = freeze(stored.join(ids, "order_id", "left_semi"), "rows-before")
        moved = before.unionByName(after).select(month_label("purchase_date").alias("purchase_month"))
        months = self._months(moved)
        run = self.snapshots.begin()
        kept = self._read_months(schema, {m: r for m, r in held.items() if m in set(months)})
        written = self._write_fact(run, kept.join(ids, "order_id", "left_anti").unionByName(after))
        now = {m: r for m, r in held.items() if m not in set(months)} | {m: run for m in written}
        cells = with_change(self.cells(manifest["version"]), signed_cells(before, after, self.settings))
        return self._commit(run, after, cells, now)

    def expire(self, keep: int = 2) -> list[str]:
        """Forget old versions; runs that still hold a month of a kept version stay."""
        return self.snapshots.expire(keep, needed=lambda manifest: set(manifest["extra"]["months"].values()))
