"""One customer and one seller each hold a third of the rows, and nothing is broadcast."""

import duckdb
import pytest

from test_oracle import FOLDERS, QUERIES, SQL, connect, sorted_rows

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def hot_folder(tmp_path_factory):
    source, target = FOLDERS["small"], tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for table in ("nation", "part", "supplier", "customer", "orders", "lineitem"):
        replaced = {
            "orders": "* REPLACE (if(hash(o_orderkey) % 3 = 0, 1, o_custkey) AS o_custkey)",
            "lineitem": "* REPLACE (if(hash(l_orderkey, l_linenumber) % 3 = 0, 7, l_suppkey) AS l_suppkey)",
        }.get(table, "*")
        con.sql(
            f"COPY (SELECT {replaced} FROM '{source}/{table}.parquet') TO '{target}/{table}.parquet'"
        )
    return str(target)


@pytest.mark.parametrize(
    "name",
    ["fct_orders", "order_seller_profile", "test_eval", "category_mix", "repeat_within_90d", "top_lanes"],
)
def test_reports_with_hot_keys(spark, hot_folder, name):
    answer = connect(hot_folder).sql(SQL[name])
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        df = QUERIES[name](spark, hot_folder)
        got = sorted_rows(df.columns, df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted_rows(answer.columns, answer.fetchall())
    assert "BroadcastHashJoin" not in plan
