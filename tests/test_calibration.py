import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanecast.operators import calibration as cal

CUT = dt.date(2018, 3, 1)
BEFORE, AFTER = dt.date(2018, 2, 28), dt.date(2018, 3, 1)
FACT = "order_id string, lane string, customer_state string, purchase_date date, total_days long, promise_error_days long, is_late boolean"


def fact(spark, rows):
    """Rows of (lane, state, date, days, error)."""
    data = [(str(i), *r, r[4] is not None and r[4] > 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, FACT)


def history(lane, state, days):
    return [(lane, state, BEFORE, d, -2) for d in days]


def tiers(spark, rows, min_orders=3):
    cells = cal.promise_cells(fact(spark, rows), CUT)
    train = cal.side(cells, cal.TRAIN)
    q = (0.90, 0.92, 0.95)
    tables = (
        cal.calibrate(train, ["lane"], q, min_orders),
        cal.calibrate(train, ["customer_state"], q),
        cal.calibrate(train, [], q),
    )
    return cells, tables, q


ROWS = (
    history("A -> X", "X", [5, 6, 7])
    + history("B -> X", "X", [20, 30])
    + history(None, None, [90, 90, 90])
    + [
        ("A -> X", "X", AFTER, 7, 1),
        ("B -> X", "X", AFTER, 9, -4),
        ("C -> Y", "Y", AFTER, 100, None),
        (None, None, AFTER, 4, -1),
    ]
)


def test_all_tiers(spark):
    cells, tables, q = tiers(spark, ROWS)
    lanes = {r.lane: (r.n_train, r.promise_90, r.promise_92, r.promise_95) for r in tables[0].collect()}
    assert lanes == {"A -> X": (3, 7, 7, 7), None: (3, 90, 90, 90)}
    judged = cal.apply_promises(cal.side(cells, cal.TEST), *tables, q)
    got = {r.lane: (r.promise_source, r.current_promise_days, r.new_90, r.new_95) for r in judged.collect()}
    state = [int(np.ceil(np.quantile([5, 6, 7, 20, 30], p))) for p in (0.9, 0.95)]
    country = [int(np.ceil(np.quantile([5, 6, 7, 20, 30, 90, 90, 90], p))) for p in (0.9, 0.95)]
    assert got == {
        "A -> X": ("1_lane", 6, 7, 7),
        "B -> X": ("2_state", 13, *state),
        "C -> Y": ("3_national", None, *country),
        None: ("3_national", 5, *country),
    }


def test_no_test_row_feeds_a_lookup(spark):
    _, tables, _ = tiers(spark, ROWS)
    changed = [r if r[2] == BEFORE else (*r[:3], 999, r[4]) for r in ROWS]
    _, again, _ = tiers(spark, changed)
    for a, b in zip(tables, again):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_policies_ignore_missing_promises(spark):
    cells, tables, q = tiers(spark, ROWS)
    judged = cal.apply_promises(cal.side(cells, cal.TEST), *tables, q)
    got = {r.policy: r for r in cal.policy_headline(judged, cal.policies(q)).collect()}
    assert list(got) == ["current", "recal_p90", "recal_p92", "recal_p95"]
    assert got["current"].mean_promise_days == pytest.approx((6 + 13 + 5) / 3)
    assert got["current"].mean_days_saved == 0
    assert got["current"].pct_on_time == pytest.approx(200 / 3)
    new = [r.new_90 for r in judged.orderBy("lane").collect()]
    assert got["recal_p90"].mean_promise_days == pytest.approx(sum(new) / 4)
    assert got["recal_p90"].pct_on_time == 75.0


def test_threshold_coverage(spark):
    rows = ROWS + history("B -> X", "X", [1, 2, 3])
    got = [tuple(r) for r in cal.threshold_coverage(fact(spark, rows), CUT, (3, 5, 9)).collect()]
    # The NULL lane has history but matches no test order; lane C has no history.
    assert got == [(3, 3, 2, 50.0), (5, 1, 1, 25.0), (9, 0, None, None)]


def test_split_boundary(spark):
    got = [tuple(r) for r in cal.temporal_split(fact(spark, ROWS), CUT).collect()]
    assert got == [("1_train", 8, BEFORE, BEFORE), ("2_test", 4, AFTER, AFTER)]


def service(spark, rows):
    lanes = spark.createDataFrame(rows, "lane string, n long, ot_current double, ot_90 double, ot_95 double")
    return lanes.withColumn("ot_recal", F.col("ot_95"))


def test_lane_reports(spark):
    lanes = service(spark, [("a", 10, 100.0, 90.0, 90.0), ("b", 10, 80.0, 85.0, 95.0), ("c", 2, 0.0, 0.0, 0.0), ("d", 12, 80.0, 80.0, 70.0)])
    spread = {r.policy: (r.worst_lane, r.best_lane, r.spread) for r in cal.service_dispersion(lanes, 10, (0.90, 0.95)).collect()}
    assert spread == {"current": (80.0, 100.0, 20.0), "recal_p90": (80.0, 90.0, 10.0), "recal_p95": (70.0, 95.0, 25.0)}
    assert [r.lane for r in cal.regressed_lanes(lanes, 10).collect()] == ["a", "d"]
    assert [r.lane for r in cal.worst_served(lanes, 10, 2).collect()] == ["b", "d"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 60)), min_size=1, max_size=80))
def test_promises_never_fall_with_the_quantile(spark, rows):
    counted = spark.createDataFrame(rows, "lane string, total_days long").groupBy("lane", "total_days").agg(
        F.count("*").alias("n")
    )
    for r in cal.calibrate(counted, ["lane"], (0.9, 0.92, 0.95)).collect():
        days = [d for k, d in rows if k == r.lane]
        assert r.promise_90 <= r.promise_92 <= r.promise_95
        assert r.promise_95 == int(np.ceil(round(float(np.quantile(days, 0.95)), 9)))


@pytest.mark.parametrize("fractions", [(0.8, 0.9), (0.95, 0.90, 0.92, 0.99), (0.99, 0.994), (0.5,), (1.0,)])
def test_any_quantiles_list_every_policy(spark, fractions):
    cells, _, _ = tiers(spark, ROWS)
    train, test = (cal.side(cells, side) for side in (cal.TRAIN, cal.TEST))
    tables = [cal.calibrate(train, keys, fractions) for keys in (["lane"], ["customer_state"], [])]
    judged = cal.apply_promises(test, *tables, fractions)
    names = ["current", *(f"recal_p{cal.mark(f)}" for f in sorted(fractions))]
    assert [r.policy for r in cal.policy_headline(judged, cal.policies(fractions)).collect()] == sorted(names)
    lanes = cal.lane_service(judged, fractions)
    assert {r.policy for r in cal.service_dispersion(lanes, 0, fractions).collect()} == set(names)
    assert cal.regressed_lanes(lanes, 0).columns == ["lane", "n", "ot_current", "ot_recal"]


@pytest.mark.parametrize("fractions", [(), (0.9, 0.9), (0.0, 0.5), (0.5, 1.2)])
def test_impossible_quantiles_are_refused(fractions):
    with pytest.raises(ValueError):
        cal.policies(fractions)


def test_quantile_names_do_not_collide():
    assert [cal.mark(f) for f in (0.9, 0.99, 0.994, 1.0, 0.05)] == ["90", "99", "99_4", "100", "5"]
