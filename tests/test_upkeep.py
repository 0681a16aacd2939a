from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lanecast.operators import calibration
from lanecast.plans import Marts
from lanecast.plans.upkeep import FactStore, signed_cells, with_change
from lanecast.settings import TPCH
from lanecast.sources import TpchSources

FOLDER = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


@pytest.fixture(scope="module")
def full(spark):
    return TpchSources(spark, FOLDER)


def sources(full, orders, items=None):
    return SimpleNamespace(
        orders=orders, items=full.items if items is None else items,
        customers=full.customers, sellers=full.sellers, bucketed=False,
    )


def check(store, now):
    marts = Marts(now, TPCH)
    same(store.fact(), marts.fact)
    same(store.cells(), calibration.promise_cells(marts.fact, TPCH.train_end))


def test_three_batches_equal_a_full_rebuild(spark, full, tmp_path):
    store = FactStore(spark, str(tmp_path), TPCH)
    key = F.col("order_id")
    first = sources(full, full.orders.where(key % 10 != 0))
    assert store.rebuild(first) == 1
    check(store, first)

    # New orders.
    second = sources(full, full.orders)
    store.apply(second, full.orders.where(key % 10 == 0).select("order_id"))
    check(store, second)

    # Another delivery date, a purchase that moves to another month, and an order that is gone.
    later = F.timestamp_add("DAY", F.lit(40), F.col("order_delivered_customer_date"))
    earlier = F.timestamp_add("DAY", F.lit(-45), F.col("order_purchase_timestamp"))
    orders = full.orders.where(key % 97 != 5).withColumns(
        {
            "order_delivered_customer_date": F.when(key % 50 == 3, later).otherwise(F.col("order_delivered_customer_date")),
            "order_purchase_timestamp": F.when(key % 83 == 1, earlier).otherwise(F.col("order_purchase_timestamp")),
        }
    )
    third = sources(full, orders)
    touched = full.orders.where((key % 97 == 5) | (key % 50 == 3) | (key % 83 == 1)).select("order_id")
    store.apply(third, touched.union(touched))
    check(store, third)

    # Items of an order that go, and orders that are named though nothing changed.
    items = full.items.where(key % 71 != 2)
    fourth = sources(full, orders, items)
    store.apply(fourth, full.orders.where(key % 71 < 4).select("order_id"))
    check(store, fourth)
    assert store.snapshots.versions() == [1, 2, 3, 4]
    same(store.cells(1), calibration.promise_cells(Marts(first, TPCH).fact, TPCH.train_end))
    store.expire(keep=1)
    check(store, fourth)


def test_only_touched_months_are_written(spark, full, tmp_path):
    store = FactStore(spark, str(tmp_path), TPCH)
    now = sources(full, full.orders)
    store.rebuild(now)
    one = store.fact().orderBy("order_id").limit(1).select("order_id", "purchase_date").first()
    store.apply(now, spark.createDataFrame([(one["order_id"],)], "order_id long"))
    months = store.snapshots.manifest()["extra"]["months"]
    run = store.snapshots.manifest()["run"]
    assert [m for m, r in months.items() if r == run] == [f"{one['purchase_date']:%Y-%m}"]
    store.expire(keep=1)
    check(store, now)
    store.apply(now, spark.createDataFrame([], "order_id long"))
    check(store, now)


def test_a_change_that_does_not_fit_is_refused(spark, full):
    fact = Marts(full, TPCH).fact
    cells = calibration.promise_cells(fact, TPCH.train_end)
    none = fact.where("false")
    same(with_change(cells, signed_cells(none, none, TPCH)), cells)
    assert with_change(cells, signed_cells(fact, none, TPCH)).collect() == []
    with pytest.raises(Exception, match="does not hold|do not hold"):
        with_change(cells, signed_cells(fact.union(fact), none, TPCH)).collect()
