"""Reading the marketplace files and landing them as Parquet."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import month_label
from ..session import freeze
from .schemas import SCHEMAS, conform

UNPARSED = "_unparsed"


@dataclass(frozen=True)
class Sources:
    """The eight input tables; ``bucketed`` if those keyed by order are bucketed by it."""

    orders: DataFrame
    customers: DataFrame
    sellers: DataFrame
    items: DataFrame
    products: DataFrame
    translation: DataFrame
    reviews: DataFrame
    payments: DataFrame
    bucketed: bool = False

    @property
    def order_headers(self) -> DataFrame:
        """All that the reports without delivery dates read."""
        return self.orders.select(
            "order_id", "customer_id", "order_status", "order_purchase_timestamp"
        )


TABLES = tuple(f.name for f in fields(Sources) if f.name != "bucketed")


def csv_options(reader, table: str, multiline: bool = False):
    """The one way CSV is read, batch or stream: typed, quoted, bad rows kept aside as text."""
    schema = StructType([*SCHEMAS[table].fields, StructField(UNPARSED, StringType())])
    return (
        reader.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", UNPARSED)
        .option("multiLine", multiline)
    )


def read_marketplace_csv(
    spark: SparkSession,
    folder: str,
    files: Mapping[str, str] | None = None,
    multiline: Collection[str] = ("reviews",),
    most_bad_rows: int = 0,
) -> Sources:
    """Read ``<table>.csv`` (or the names in ``files``) with header and explicit types.

    A row is bad if a value does not fit its type or the number of fields is wrong.
    Every file is parsed once in full: bad rows are written as they stand to the shared
    folder, and more than ``most_bad_rows`` of them over all tables are an error that
    tells their number by table and their place.  If some are allowed, the good rows of
    their tables are written too, so that all reports read the same rows.

    ``multiline`` names the tables whose quoted text may hold newlines.  Such a file
    cannot be split, so one file is one task; its rows are dealt out evenly after the
    parse.  Split large tables into several files (the name may be a folder or pattern).
    """
    names = {table: f"{table}.csv" for table in TABLES} | dict(files or {})
    frames, told, total = {}, [], 0
    for table in TABLES:
        reader = csv_options(spark.read, table, table in multiline).option("enforceSchema", False)
        path = f"{folder.rstrip('/')}/{names[table]}"
        rows = reader.csv(path)
        # Without bad rows the plain reader gives the same and prunes columns.
        good = reader.schema(SCHEMAS[table]).csv(path)
        bad = freeze(rows.where(F.col(UNPARSED).isNotNull()), f"unparsed-{table}")
        n = bad.count()
        if n:
            place = bad.inputFiles()[0].rpartition("/")[0]
            told.append(f"{n} rows of {table}, see {place}")
            total += n
            every = csv_options(spark.read, table, table in multiline).csv(path)
            good = freeze(every.where(F.col(UNPARSED).isNull()).drop(UNPARSED), f"parsed-{table}")
        if table in multiline:
            good = good.repartition(spark.sparkContext.defaultParallelism)
        frames[table] = good
    if total > most_bad_rows:
        raise ValueError(f"{total} rows do not parse: " + "; ".join(told))
    return Sources(**frames)


def land(sources: Sources, folder: str) -> None:
    """Write every source once as Parquet; orders are partitioned by purchase month.

    ``rebalance`` evens out the files: a month with most of the orders is split
    over many tasks and small months are merged.
    """
    for table in TABLES:
        df = getattr(sources, table)
        target = f"{folder.rstrip('/')}/{table}"
        if table == "orders":
            df = df.withColumn("purchase_month", month_label("order_purchase_timestamp"))
            df = df.hint("rebalance", "purchase_month")
            df.write.mode("overwrite").partitionBy("purchase_month").parquet(target)
        else:
            df.write.mode("overwrite").parquet(target)


def read_landed(spark: SparkSession, folder: str) -> Sources:
    """Landed tables; orders keep their month so that the window prunes partitions."""
    frames = {}
    for table in TABLES:
        df = spark.read.parquet(f"{folder.rstrip('/')}/{table}")
        kept = ["purchase_month"] if table == "orders" else []
        frames[table] = conform(df, table, keep=kept)
    return Sources(**frames)


# The tables that the fact and the outcomes join by order.
BY_ORDER = ("orders", "items", "reviews", "payments")


def land_bucketed(sources: Sources, database: str, buckets: int) -> None:
    """Save the sources as tables, those keyed by order in equal buckets of it.

    Grouping and joining by order then needs no shuffle.  A bucket is one task,
    so this suits data without a dominant order id; ``land`` has no such limit.
    """
    for table in TABLES:
        df = getattr(sources, table)
        writer = df.write
        if table in BY_ORDER:
            writer = df.repartition(buckets, "order_id").write
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.mode("overwrite").format("parquet").saveAsTable(f"{database}.{table}")


def read_bucketed(spark: SparkSession, database: str) -> Sources:
    frames = {t: conform(spark.table(f"{database}.{t}"), t) for t in TABLES}
    return Sources(**frames, bucketed=True)
