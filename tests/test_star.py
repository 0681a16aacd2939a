import random

import pytest

from frames import frame, simple_order, sources
from lanecast.operators import lead_time, star
from lanecast.plans import REPORTS, Marts


def item(order_id, seller_id, limit, product_id="p", price=10.0):
    return {
        "order_id": order_id,
        "seller_id": seller_id,
        "product_id": product_id,
        "shipping_limit_date": limit,
        "price": price,
    }


def seller(seller_id, state):
    return {"seller_id": seller_id, "seller_state": state}


def customer(customer_id, state, person=None):
    return {"customer_id": customer_id, "customer_state": state, "customer_unique_id": person}


def profile(spark, items, sellers):
    rows = star.order_sellers(frame(spark, "items", items), frame(spark, "sellers", sellers)).collect()
    return {r.order_id: r.asDict() for r in rows}


def test_origin_rule(spark):
    items = [
        item("latest", "s1", "2018-01-01 00:00:00"),
        item("latest", "s2", "2018-01-02 00:00:00"),
        item("tie", "s2", "2018-01-02 00:00:00"),
        item("tie", "s1", "2018-01-02 00:00:00"),
        item("null limit", "s1", None),
        item("null limit", "s3", "1950-01-01 00:00:00"),
        item("all null", "s2", None),
        item("all null", "s1", None),
        item("repeat", "s1", "2018-01-01 00:00:00"),
        item("repeat", "s1", "2018-01-05 00:00:00"),
        item("repeat", "unknown", "2018-01-03 00:00:00"),
    ]
    got = profile(spark, items, [seller("s1", "SP"), seller("s2", "SP"), seller("s3", None)])
    origin = {k: (v["seller_id"], v["seller_state"]) for k, v in got.items()}
    assert origin == {
        "latest": ("s2", "SP"),
        "tie": ("s1", "SP"),
        "null limit": ("s3", None),
        "all null": ("s1", "SP"),
        "repeat": ("s1", "SP"),
    }
    counts = {k: (v["n_items"], v["n_sellers"], v["n_seller_states"]) for k, v in got.items()}
    assert counts == {
        "latest": (2, 2, 1),
        "tie": (2, 2, 1),
        "null limit": (2, 2, 1),
        "all null": (2, 2, 1),
        "repeat": (3, 2, 1),
    }


def fixture_marts(spark):
    orders = [
        simple_order("a", customer="c1"),
        simple_order("b", customer="c2"),
        simple_order("c", customer="c3"),
        simple_order("no items", customer="c1"),
        simple_order("d", customer="missing"),
    ]
    items = [item(o, "s1", "2018-01-11 00:00:00") for o in ("a", "b", "d")]
    items += [item("c", "s2", "2018-01-11 00:00:00"), item("c", "s1", "2018-01-10 00:00:00")]
    customers = [customer("c1", "SP"), customer("c2", "RJ"), customer("c3", None)]
    sellers = [seller("s1", "SP"), seller("s2", "RJ")]
    return Marts(sources(spark, orders=orders, items=items, customers=customers, sellers=sellers))


def test_fact_lanes_and_integrity(spark):
    marts = fixture_marts(spark)
    got = {r.order_id: (r.lane, r.is_intrastate, r.origin_ambiguous) for r in REPORTS["fct_orders"](marts).collect()}
    assert got == {
        "a": ("SP -> SP", True, False),
        "b": ("SP -> RJ", False, False),
        "c": (None, None, True),
        "d": (None, None, False),
    }
    check = REPORTS["fact_integrity"](marts).first()
    assert check.asDict() == {
        "base_rows": 5,
        "fact_rows": 4,
        "distinct_orders": 4,
        "null_cust_state": 2,
        "null_sell_state": 0,
    }
    star.require_integrity(marts.base, marts.fact, "order_id")
    cover = REPORTS["items_coverage"](marts).first()
    assert tuple(cover) == (5, 4, 1)
    lanes = REPORTS["lane_coverage"](marts).first()
    assert tuple(lanes) == (2, 1, 50.0, 1)


def test_duplicate_dimension_is_caught(spark):
    marts = fixture_marts(spark)
    doubled = marts.sources.customers.union(marts.sources.customers)
    fact = star.build_fact(marts.segments, marts.profile, doubled)
    with pytest.raises(ValueError, match="one row per order"):
        star.require_integrity(marts.base, fact, "order_id")


def test_volume_ties_fall_back_to_the_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), (None, 2), ("c", 1)], "k string, n_orders long")
    assert [r.k for r in star.largest(df, "k", 3).collect()] == ["a", "b", None]


def test_fastest_and_slowest(spark):
    rows = [(f"s{i}", i) for i in range(8) for _ in range(3)] + [("rare", 0)]
    df = spark.createDataFrame(rows, "st string, transit_hours long")
    got = [(r.grp, r.st) for r in star.fastest_and_slowest(df, "st", 3, 2).collect()]
    assert got == [("fastest", "s0"), ("fastest", "s1"), ("slowest", "s6"), ("slowest", "s7")]


def brute_profile(items, states):
    by_order = {}
    for o, s, limit in items:
        by_order.setdefault(o, []).append((s, limit))
    out = {}
    for o, rows in by_order.items():
        origin = min(rows, key=lambda r: (-r[1], r[0]))[0]
        sellers = {s for s, _ in rows}
        known = {states[s] for s in sellers if states.get(s)}
        out[o] = (origin, len(rows), len(sellers), len(known))
    return out


def test_hot_order_and_hot_seller_are_split(spark):
    """One order and one seller each hold a third of the items; no broadcast."""
    rng = random.Random(7)
    states = {s: rng.choice(["SP", "RJ", "MG", None]) for s in range(4000)}
    items = [("hot", rng.randrange(4000), rng.randrange(10**6)) for _ in range(20_000)]
    items += [(f"o{rng.randrange(15_000)}", 0, rng.randrange(10**6)) for _ in range(20_000)]
    items += [(f"o{rng.randrange(15_000)}", rng.randrange(4000), rng.randrange(10**6)) for _ in range(20_000)]
    df = spark.createDataFrame(items, "order_id string, seller_id long, t long").selectExpr(
        "order_id", "seller_id", "timestampadd(SECOND, t, TIMESTAMP_NTZ '2018-01-01') AS shipping_limit_date"
    )
    dim = spark.createDataFrame(list(states.items()), "seller_id long, seller_state string")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = star.order_sellers(df, dim)
        got = {r.order_id: (r.seller_id, r.n_items, r.n_sellers, r.n_seller_states) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute_profile(items, states)
    assert "skew=true" in plan


def test_multi_seller_uses_trusted_orders_only(spark):
    marts = fixture_marts(spark)
    suspect = lead_time.build_base(marts.sources.orders, marts.settings)
    assert suspect.where("approval_suspect").count() == 0
    got = {r.grp: r.n_orders for r in REPORTS["multi_seller_effect"](marts).collect()}
    assert got == {"single seller": 3, "multi seller": 1}


def test_a_missing_seller_loses_a_tie(spark):
    from lanecast.operators.distribution import first_per_key

    src = sources(
        spark,
        items=[item("1", None, "2018-01-12 00:00:00"), item("1", "a", "2018-01-12 00:00:00"), item("2", None, "2018-01-12 00:00:00")],
        sellers=[seller("a", "RJ")],
    )
    got = {r.order_id: r.seller_id for r in star.order_sellers(src.items, src.sellers).collect()}
    assert got == {"1": "a", "2": None}
    rows = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("k", 3, 3)], "key string, at long, v long")
    assert first_per_key(rows, "key", ["at"], ["v"]).first().v == 3
