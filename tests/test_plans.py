"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as contract
from lanecast.plans import DERIVED, REPORTS, Marts
from lanecast.sources import TpchSources
from lanecast.settings import TPCH

FOLDER = "/root/testdata/sf0.001"
QUERIES = {n: contract.queries()[n] for n in (*REPORTS, *DERIVED)}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cartesian(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert word not in plan, word


@pytest.mark.parametrize("name", ["segment_distributions", "base_funnel", "timestamp_completeness"])
def test_multi_measure_reports_read_orders_once(spark, name):
    plan = executed(QUERIES[name](spark, FOLDER))
    assert plan.count("orders.parquet") == 1


@pytest.mark.parametrize("name", ["variance_dest_vs_lane", "lane_threshold_coverage", "top_lanes"])
def test_fact_reports_build_the_fact_once(spark, name):
    plan = executed(QUERIES[name](spark, FOLDER))
    assert plan.count("orders.parquet") == 1
    assert plan.count("lineitem.parquet") == 2  # the derived timeline and the items


def test_counts_combine_before_the_shuffle(spark):
    plan = executed(QUERIES["lane_promise"](spark, FOLDER))
    assert "partial_count" in plan
    counted = [line for line in plan.splitlines() if "Exchange hashpartitioning(lane" in line]
    assert any("total_days" in line for line in counted)


def test_category_mix_sums_products_before_joining(spark):
    plan = executed(QUERIES["category_mix"](spark, FOLDER))
    below = plan.split("part.parquet")[0]
    assert "partial_sum" in below and "TakeOrderedAndProject" in plan


def test_calibration_reads_frozen_cells(spark):
    plan = executed(QUERIES["policy_headline"](spark, FOLDER))
    assert "promise_cells" in plan and "lineitem.parquet" not in plan


def test_frozen_tables_go_to_the_configured_folder(spark):
    marts = Marts(TpchSources(spark, FOLDER), TPCH)
    files = marts.cells.inputFiles()
    assert files and all(spark.conf.get("spark.checkpoint.dir") in f for f in files)


def test_lookups_shuffle_when_too_large_to_broadcast(spark):
    expected = sorted(map(str, REPORTS["test_eval"](Marts(TpchSources(spark, FOLDER), TPCH)).collect()))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        df = REPORTS["test_eval"](Marts(TpchSources(spark, FOLDER), TPCH))
        got = sorted(map(str, df.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == expected
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
