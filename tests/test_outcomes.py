import datetime as dt

from frames import frame, simple_order, sources
from test_star import customer, item
from lanecast.operators import outcomes
from lanecast.plans import REPORTS, Marts


def review(order_id, score, date, review_id):
    return {"order_id": order_id, "review_score": score, "review_creation_date": date, "review_id": review_id}


def payment(order_id, value):
    return {"order_id": order_id, "payment_value": value}


def outcome_marts(spark):
    orders = [simple_order("a"), simple_order("b", days=15), simple_order("c", customer="nobody"), simple_order("x")]
    return Marts(
        sources(
            spark,
            orders=orders,
            items=[item(o, "s1", "2018-01-11 00:00:00") for o in "abc"],
            customers=[customer("c1", "SP", "ana")],
            reviews=[
                review("a", 1, "2018-01-20 00:00:00", "r1"),
                review("a", 5, "2018-01-21 00:00:00", "r0"),
                review("b", 2, "2018-01-21 00:00:00", "r2"),
                review("b", 4, "2018-01-21 00:00:00", "r3"),
                review("c", 3, None, "r9"),
                review("c", 1, "2000-01-01 00:00:00", "r8"),
            ],
            payments=[payment("a", 0.1), payment("a", 0.2), payment("a", 10.0), payment("b", 5.0)],
        )
    )


def test_one_row_per_order_with_latest_review_and_summed_payments(spark):
    got = {r.order_id: r for r in outcome_marts(spark).outcomes.collect()}
    assert {k: (r.review_score, r.customer_unique_id) for k, r in got.items()} == {
        "a": (5, "ana"),
        "b": (4, "ana"),
        "c": (1, None),
    }
    assert float(got["a"].order_value) == 10.30
    assert got["c"].order_value is None


def test_coverage_and_revenue(spark):
    marts = outcome_marts(spark)
    assert tuple(REPORTS["outcome_coverage"](marts).first()) == (3, 3, 2, 2)
    revenue = {r.is_late: (r.n_orders, r.total_brl) for r in REPORTS["revenue_exposure"](marts).collect()}
    assert revenue == {False: (1, 10.3), True: (1, 5.0)}
    stars = {r.is_late: (r.n_orders, r.mean_score, r.pct_1_star) for r in REPORTS["review_by_lateness"](marts).collect()}
    assert stars == {False: (2, 3.0, 50.0), True: (1, 4.0, 0.0)}


def test_repeat_rule(spark):
    first = dt.date(2018, 1, 10)
    firsts = spark.createDataFrame(
        [(p, first, False) for p in ("day0", "day1", "day90", "day91", "many")]
        + [("too late", dt.date(2018, 6, 2), True), ("last day", dt.date(2018, 6, 1), True), (None, first, True)],
        "person string, purchase_date date, is_late boolean",
    )
    days = [("day0", 0), ("day1", 1), ("day90", 90), ("day91", 91), ("many", 3), ("many", 80), (None, 5)]
    per_day = spark.createDataFrame(
        [(p, first + dt.timedelta(days=d), 2) for p, d in days], "person string, day date, n long"
    )
    got = outcomes.followup_within(firsts, per_day, "person", 90, dt.date(2018, 6, 1))
    assert {r.person: r.n_repeat for r in got.collect()} == {
        "day0": 0, "day1": 2, "day90": 2, "day91": 0, "many": 4, "last day": 0, None: 0,
    }
    rates = {r.is_late: (r.n_customers, r.p) for r in outcomes.repeat_rate(got, "p").collect()}
    assert rates == {False: (5, 60.0), True: (2, 0.0)}


def test_followups_count_orders_of_any_status_and_record(spark):
    orders = [
        simple_order("1", customer="c1"),
        simple_order("2", bought="2018-02-01 09:00:00", customer="c2", status="canceled"),
        simple_order("3", bought="2018-02-01 11:00:00", customer="c2"),
    ]
    marts = Marts(
        sources(
            spark,
            orders=orders,
            items=[item(o, "s1", "2018-01-11 00:00:00") for o in "123"],
            customers=[customer("c1", "SP", "ana"), customer("c2", "SP", "ana")],
        )
    )
    got = marts.followups.collect()
    assert [(r.customer_unique_id, r.n_repeat) for r in got] == [("ana", 2)]
    assert REPORTS["repeat_within_90d"](marts).first().pct_repeat_90d == 100.0


def test_first_order_tie_takes_the_lowest_id(spark):
    day = dt.date(2018, 1, 1)
    df = spark.createDataFrame(
        [("p", "o2", day, True), ("p", "o1", day, False)],
        "person string, order_id string, purchase_date date, is_late boolean",
    )
    assert outcomes.first_orders(df, "person").first().is_late is False


def test_one_person_with_a_third_of_all_orders(spark):
    """A dominant person shrinks to one row per day before the range join."""
    headers = spark.range(30_000).selectExpr(
        "id AS order_id",
        "if(id % 3 = 0, 'hot', concat('c', id)) AS customer_id",
        "timestampadd(DAY, int(id % 200), TIMESTAMP_NTZ '2018-01-01 10:00:00') AS order_purchase_timestamp",
    )
    customers = headers.selectExpr("customer_id", "customer_id AS person").distinct()
    per_day = outcomes.order_days(headers, customers, "person")
    assert per_day.where("person = 'hot'").count() == 200
    firsts = spark.createDataFrame(
        [("hot", dt.date(2018, 1, 1), False)], "person string, purchase_date date, is_late boolean"
    )
    got = outcomes.followup_within(firsts, per_day, "person", 90, dt.date(2018, 6, 1)).first()
    assert got.n_repeat == 10_000 // 200 * 90


def test_category_mix(spark):
    items = frame(
        spark,
        "items",
        [item("o", "s", None, p, price) for p, price in [("p1", 1.0), ("p1", 2.0), ("p2", 4.0), ("gone", 8.0), ("p3", None)]],
    )
    products = frame(
        spark,
        "products",
        [
            {"product_id": "p1", "product_category_name": "brinquedos", "product_weight_g": 500.0},
            {"product_id": "p2", "product_category_name": "brinquedos", "product_weight_g": None},
            {"product_id": "p3", "product_category_name": "sem", "product_weight_g": 100.0},
        ],
    )
    names = frame(spark, "translation", [{"product_category_name": "brinquedos", "product_category_name_english": "toys"}])
    got = [tuple(r) for r in outcomes.category_mix(items, products, names, 15).collect()]
    assert got == [("toys", 3, 7 / 3, 0.5), ("sem", 1, None, 0.1), ("unknown", 1, 8.0, None)]
    assert len(outcomes.category_mix(items, products, names, 1).collect()) == 1
