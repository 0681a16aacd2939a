"""The base table over a folder that keeps receiving order files.

The batch operators run unchanged on a stream.  Files may be delivered again or
overlap: an order's first measurable row is appended and every later one is dropped, by a
state of order ids that lives as long as the feed (orders have no last delivery date, so no
watermark may forget them; it grows by one key per order, so use the RocksDB state store
on a cluster).  Reports run on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import month_label
from ..operators.lead_time import build_base, with_segments
from ..settings import MARKETPLACE, Settings
from ..sources.marketplace import UNPARSED, csv_options


def read_order_feed(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Order CSV files as they arrive; ``_unparsed`` holds the text of rows that don't parse."""
    reader = csv_options(spark.readStream, "orders")
    return reader.option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def append_base(
    orders: DataFrame, target: str, checkpoint: str, s: Settings = MARKETPLACE
) -> StreamingQuery:
    """Append measurable orders with segment hours, by purchase month; stops when caught up.

    One row per order, however often it is delivered.  A row that doesn't parse stops
    the feed with its text, and the batch is tried again once the file is mended.
    ``checkpoint`` belongs on shared storage: after a loss the query resumes from
    it, and the file sink commits every batch once.
    """
    if UNPARSED in orders.columns:
        wrong = F.raise_error(F.concat(F.lit("order row does not parse: "), F.col(UNPARSED)))
        status = F.when(F.col(UNPARSED).isNull(), F.col("order_status")).otherwise(wrong)
        orders = orders.withColumn("order_status", status).drop(UNPARSED)
    base = with_segments(build_base(orders, s)).dropDuplicates(["order_id"])
    return (
        base.withColumn("purchase_month", month_label("purchased_at"))
        .writeStream.format("parquet")
        .partitionBy("purchase_month")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
