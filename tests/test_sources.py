import csv

import pytest
from pyspark.sql import functions as F

from frames import simple_order, sources
from test_star import customer, item, seller
from lanecast.operators import lead_time, star
from lanecast.plans import REPORTS, Marts
from lanecast.settings import MARKETPLACE, TPCH
from lanecast.sources import (
    SCHEMAS,
    TpchSources,
    conform,
    land,
    land_bucketed,
    read_bucketed,
    read_landed,
    read_marketplace_csv,
)


def write_csv(folder, table, rows, encoding="utf-8"):
    names = SCHEMAS[table].names
    with open(folder / f"{table}.csv", "w", newline="", encoding=encoding) as f:
        out = csv.writer(f)
        out.writerow(names)
        out.writerows([[row.get(n, "") for n in names] for row in rows])


@pytest.fixture()
def csv_folder(tmp_path):
    write_csv(tmp_path, "orders", [simple_order("1"), {**simple_order("2"), "order_approved_at": ""}])
    write_csv(tmp_path, "customers", [{"customer_id": "c1", "customer_zip_code_prefix": "01037", "customer_state": "SP"}])
    write_csv(tmp_path, "sellers", [{"seller_id": "s1", "seller_zip_code_prefix": "00042", "seller_state": "RJ"}])
    write_csv(tmp_path, "items", [{"order_id": "1", "order_item_id": 1, "seller_id": "s1", "product_id": "p", "shipping_limit_date": "2018-01-12 00:00:00", "price": "10.50"}])
    write_csv(tmp_path, "products", [{"product_id": "p", "product_category_name": "a", "product_weight_g": "200"}])
    write_csv(tmp_path, "translation", [{"product_category_name": "a", "product_category_name_english": "b"}], "utf-8-sig")
    write_csv(
        tmp_path,
        "reviews",
        [
            {"review_id": "r1", "order_id": "1", "review_score": 4, "review_comment_message": 'two\nlines, and a ""quote"', "review_creation_date": "2018-01-20 00:00:00"},
            {"review_id": "r2", "order_id": "1", "review_score": 5, "review_creation_date": "2018-01-21 00:00:00"},
        ],
    )
    write_csv(tmp_path, "payments", [{"order_id": "1", "payment_value": "10.50"}])
    return str(tmp_path)


def test_csv_types_quotes_and_empty_times(spark, csv_folder):
    got = read_marketplace_csv(spark, csv_folder)
    assert got.orders.schema["order_purchase_timestamp"].dataType.simpleString() == "timestamp_ntz"
    rows = {r.order_id: r for r in got.orders.collect()}
    assert str(rows["1"].order_purchase_timestamp) == "2018-01-10 09:00:00"
    assert rows["2"].order_approved_at is None
    assert got.customers.first().customer_zip_code_prefix == "01037"
    reviews = got.reviews.orderBy("review_id").collect()
    assert len(reviews) == 2
    assert reviews[0].review_comment_message == 'two\nlines, and a ""quote"'


def add_line(folder, table, line):
    with open(f"{folder}/{table}.csv", "a") as f:
        f.write(line + "\n")


@pytest.mark.parametrize(
    "table, line",
    [
        ("orders", "9,c1,delivered,2018-01-10 09:00:00,10/01/2018 10:00,,,2018-01-30 00:00:00"),
        ("orders", "9,c1,delivered,2018-01-10 09:00:00"),
        ("payments", "1,1,card,1,12.5,extra"),
        ("payments", "1,1,card,1,a lot"),
        ("reviews", "r9,1,five,,,2018-01-20 00:00:00,"),
    ],
)
def test_rows_that_do_not_parse_are_counted_and_kept(spark, csv_folder, table, line):
    add_line(csv_folder, table, line)
    with pytest.raises(ValueError, match=f"1 rows do not parse: 1 rows of {table}, see ") as e:
        read_marketplace_csv(spark, csv_folder)
    kept = spark.read.parquet(str(e.value).rpartition("see ")[2])
    assert [r["_unparsed"] for r in kept.collect()] == [line]
    allowed = read_marketplace_csv(spark, csv_folder, most_bad_rows=1)
    assert allowed.orders.count() == 2 and allowed.payments.count() == 1
    assert allowed.orders.select("order_id").count() == 2
    assert allowed.reviews.count() == 2


def test_a_table_in_many_files(spark, csv_folder, tmp_path):
    import os

    parts = tmp_path / "parts"
    parts.mkdir()
    for k in range(5):
        write_csv(parts, "reviews", [{"review_id": f"r{k}", "order_id": "1", "review_score": 4, "review_comment_message": "a\nb", "review_creation_date": "2018-01-20 00:00:00"}])
        os.rename(parts / "reviews.csv", parts / f"{k}.csv")
    got = read_marketplace_csv(spark, csv_folder, files={"reviews": "parts/*.csv"}).reviews
    assert got.count() == 5 and {r.review_comment_message for r in got.collect()} == {"a\nb"}


def test_csv_to_reports(spark, csv_folder):
    marts = Marts(read_marketplace_csv(spark, csv_folder))
    fact = REPORTS["fct_orders"](marts).collect()
    assert [(r.order_id, r.lane) for r in fact] == [("1", "RJ -> SP")]
    assert REPORTS["order_outcomes"](marts).first().review_score == 5
    assert REPORTS["category_mix"](marts).first().category == "b"


def test_conform_reports_every_problem(spark):
    df = spark.sql("SELECT 'a' AS ORDER_ID, 'x' AS amount")
    with pytest.raises(ValueError, match="payment_value: string, expected double"):
        conform(df, "payments", {"payment_value": "amount"})
    with pytest.raises(ValueError, match="payment_value: no column"):
        conform(df, "payments")
    good = conform(df.withColumn("amount", F.lit(1.5)), "payments", {"payment_value": "amount"})
    assert good.columns == ["order_id", "payment_value"]


def small_sources(spark):
    months = ["2016-11", "2017-03", "2018-01", "2018-10"]
    return sources(
        spark,
        orders=[simple_order(m, bought=f"{m}-10 09:00:00") for m in months],
        items=[item(m, "s1", "2018-01-12 00:00:00") for m in months],
        customers=[customer("c1", "SP", "ana")],
        sellers=[seller("s1", "RJ")],
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_landed_orders_are_pruned_by_month(spark, tmp_path):
    land(small_sources(spark), str(tmp_path))
    orders = read_landed(spark, str(tmp_path)).orders
    base = lead_time.build_base(orders, MARKETPLACE)
    assert {r.order_id for r in base.collect()} == {"2017-03", "2018-01"}
    plan = plan_of(base.select("order_id"))
    assert "PartitionFilters: [isnotnull(purchase_month" in plan
    assert "(purchase_month" in plan and "2018-09" in plan
    pushed = plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "EqualTo(order_status,delivered)" in pushed
    assert "GreaterThanOrEqual(order_purchase_timestamp" in pushed
    assert "order_estimated_delivery_date" not in plan.split("ReadSchema:")[1]


def test_bucketed_sources_need_no_shuffle_by_order(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS market")
    land_bucketed(small_sources(spark), "market", 4)
    src = read_bucketed(spark, "market")
    segments = lead_time.with_segments(lead_time.build_base(src.orders, MARKETPLACE))
    fact = star.build_fact(segments, star.order_sellers(src.items, src.sellers, src.bucketed), src.customers)
    assert {r.order_id for r in fact.collect()} == {"2017-03", "2018-01"}
    assert "Exchange hashpartitioning" not in plan_of(fact)


def test_tpch_fixture_counts(spark):
    """Counts measured beforehand on the same tables."""
    marts = Marts(TpchSources(spark, "/root/testdata/sf0.001"), TPCH)
    assert marts.sources.orders.count() == 1500
    assert marts.base.count() == 832
    assert marts.base.where("approval_suspect").count() == 11
    fact = marts.fact
    assert (fact.count(), fact.where("purchase_date < '1999-07-01'").count()) == (819, 600)


def test_headers_equal_the_timeline(spark):
    src = TpchSources(spark, "/root/testdata/sf0.001")
    full = src.orders.select(src.order_headers.columns)
    assert full.exceptAll(src.order_headers).count() == 0
    assert src.order_headers.count() == full.count()
