"""Write a larger, skewed copy of the order tables for timing.

    python scaled_tables.py --source /root/testdata/sf0.1 --out /tmp/scaled --times 20

Every table keyed by order is repeated with shifted order keys.  A third of all orders go to
one customer and a third of all items to one seller, chosen by hash, so joins by customer
and by seller meet a hot key.  ``BENCH_SF_DIR=<out> python bench.py`` times the reports on it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from lanecast.session import build_session

# Tables that are copied as they are.
SMALL = ("nation", "customer", "supplier", "part")
# Key to shift, and the column that a third of the rows share.
REPEATED = {"orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_suppkey")}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--source", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--times", type=int, default=20)
    args = parser.parse_args()
    spark = build_session("scaled-tables", master="local[*]")
    read = lambda t: spark.read.parquet(f"{args.source}/{t}.parquet")
    for table in SMALL:
        read(table).write.mode("overwrite").parquet(f"{args.out}/{table}.parquet")
    step = read("orders").agg(F.max("o_orderkey")).first()[0] + 1
    copies = F.explode(F.sequence(F.lit(0), F.lit(args.times - 1)))
    for table, (key, hot) in REPEATED.items():
        rows = read(table).withColumn("copy", copies)
        third = F.pmod(F.xxhash64(*read(table).columns, "copy"), F.lit(3)) == 0
        rows = rows.withColumn(hot, F.when(third, F.lit(1)).otherwise(F.col(hot)).cast("long"))
        rows = rows.withColumn(key, F.col(key) + F.col("copy") * F.lit(step)).drop("copy")
        rows.repartition(4 * args.times).write.mode("overwrite").parquet(f"{args.out}/{table}.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
