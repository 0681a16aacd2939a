"""An order timeline derived from the TPC-H-like tables.

Those tables hold no approval, carrier or delivery times, so they are computed
from the keys with integer arithmetic: any engine derives the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400

# The columns read and their types; stating them saves a job per table.
COLUMNS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "part": "p_partkey long, p_type string, p_size int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, "
    "l_shipdate timestamp_ntz, l_extendedprice double",
}


def _status() -> str:
    return "if(o_orderstatus = 'P', 'shipped', 'delivered')"


def _at(seconds: str, ts: str = "o_orderdate") -> str:
    return f"timestampadd(SECOND, int({seconds}), {ts})"


BOUGHT = f"(o_orderkey * 7919) % {DAY}"


class TpchSources:
    """The eight source tables, each derived when first used."""

    bucketed = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.folder = sf_dir.rstrip("/")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(COLUMNS[table]).parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def order_headers(self) -> DataFrame:
        """Orders without delivery dates, which need no other table."""
        return self.read("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            f"{_status()} AS order_status",
            f"{_at(BOUGHT)} AS order_purchase_timestamp",
        )

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with five timestamps; travel time depends on both parties' nations.

        ``k`` is the order key, ``sn`` and ``cn`` the nation keys of the order's
        highest supplier key and of its customer.  Every moment is first a number
        of seconds after the order date.
        """
        last_supplier = (
            self.read("lineitem")
            .groupBy("l_orderkey")
            .agg(F.max("l_suppkey").alias("s_suppkey"))
            .join(self.read("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
            .selectExpr("l_orderkey AS o_orderkey", "s_nationkey")
        )
        customer = self.read("customer").selectExpr("c_custkey AS o_custkey", "c_nationkey")
        keyed = (
            self.read("orders")
            .join(last_supplier, "o_orderkey", "left")
            .join(customer, "o_custkey", "left")
            .selectExpr(
                "o_orderkey AS k",
                "o_custkey AS customer_id",
                f"{_status()} AS order_status",
                "o_orderdate",
                f"{BOUGHT} AS bought",
                "coalesce(bigint(s_nationkey), 0) AS sn",
                "bigint(c_nationkey) AS cn",
            )
        )
        approval_wait = "if(k % 13 = 0, (k * 104729) % 172800, (k * 104729) % 7200)"
        handoff_wait = (
            "CASE WHEN k % 1009 = 0 THEN -(691200 + (k * 31) % 864000) "
            "WHEN k % 71 = 0 THEN -((k * 48611) % 259200) ELSE (k * 15485) % 518400 END"
        )
        travel = (
            f"{DAY} * (2 + (sn + cn) % 9) + (k * 32452) % ({DAY} * (1 + (sn * cn) % 17)) "
            f"+ if(k % 19 = 0, (k * 99991) % ({DAY} * 25), 0)"
        )
        return (
            keyed.selectExpr("*", f"bought + {approval_wait} AS approved")
            .selectExpr("*", f"approved + {handoff_wait} AS shipped")
            .selectExpr("*", f"shipped + {travel} AS delivered")
            .selectExpr(
                "k AS order_id",
                "customer_id",
                "order_status",
                f"{_at('bought')} AS order_purchase_timestamp",
                f"if(k % 211 <> 0, {_at('approved')}, NULL) AS order_approved_at",
                f"if(k % 307 <> 0, {_at('shipped')}, NULL) AS order_delivered_carrier_date",
                f"if(k % 401 <> 0, {_at('delivered')}, NULL) AS order_delivered_customer_date",
                f"if(k % 503 <> 0, {_at(f'{DAY} * (12 + (sn + cn) % 9 + k % 5)')}, NULL) "
                "AS order_estimated_delivery_date",
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.read("nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
        return (
            self.read("customer")
            .join(nation, "c_nationkey", "left")
            .selectExpr(
                "c_custkey AS customer_id",
                "c_custkey - c_custkey % 2 AS customer_unique_id",
                "lpad(string(c_custkey), 5, '0') AS customer_zip_code_prefix",
                "concat('CITY_', c_custkey % 50) AS customer_city",
                "if(c_custkey % 97 <> 0, n_name, NULL) AS customer_state",
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        nation = self.read("nation").selectExpr("n_nationkey AS s_nationkey", "n_name")
        return (
            self.read("supplier")
            .join(nation, "s_nationkey", "left")
            .selectExpr(
                "s_suppkey AS seller_id",
                "lpad(string(s_suppkey), 5, '0') AS seller_zip_code_prefix",
                "concat('CITY_', s_suppkey % 50) AS seller_city",
                "n_name AS seller_state",
            )
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "l_suppkey AS seller_id",
            "l_shipdate AS shipping_limit_date",
            "l_extendedprice AS price",
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.read("part").selectExpr(
            "p_partkey AS product_id",
            "CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN lower(p_type) "
            "ELSE concat(lower(p_type), '_', p_size % 5) END AS product_category_name",
            "p_size * 100.0D AS product_weight_g",
        )

    @cached_property
    def translation(self) -> DataFrame:
        return self.spark.sql(
            "SELECT * FROM VALUES ('economy', 'economy_en'), ('promo', 'promo_en'), "
            "('large', 'large_en'), ('small', 'small_en') "
            "AS t(product_category_name, product_category_name_english)"
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """One or two reviews per order; both may carry one date, so the id breaks the tie.

        Some first reviews have no score.
        """
        late = "order_delivered_customer_date > order_estimated_delivery_date"
        wait = f"{DAY} * if(order_id % 58 = 0, 1, r)"
        return (
            self.orders.withColumn("r", F.explode(F.array(F.lit(1), F.lit(2))))
            .where("r = 1 OR order_id % 29 = 0")
            .selectExpr(
                "order_id * 10 + r AS review_id",
                "order_id",
                f"int(CASE WHEN r = 1 AND order_id % 143 = 0 THEN NULL WHEN {late} "
                "THEN 1 + (order_id * 31 + r) % 3 ELSE 3 + (order_id * 17 + r) % 3 END) "
                "AS review_score",
                f"{_at(wait, 'order_estimated_delivery_date')} AS review_creation_date",
            )
        )

    @cached_property
    def payments(self) -> DataFrame:
        """One payment per item; some orders' payments have no value."""
        return self.read("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "if(l_orderkey % 113 <> 0, CAST(l_extendedprice AS decimal(18,2)), NULL) "
            "AS payment_value",
        )
