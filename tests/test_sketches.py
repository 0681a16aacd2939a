import datetime as dt
import random

import pytest

from lanecast.operators import sketches as S

DAY = dt.date(2018, 1, 1)


def fact(spark, n, lanes, seed=1):
    rng = random.Random(seed)
    rows = [
        (rng.choice(lanes), "s", DAY + dt.timedelta(days=rng.randrange(20)), min(400, int(rng.expovariate(0.02))))
        for _ in range(n)
    ]
    schema = "lane string, customer_state string, purchase_date date, total_days int"
    return rows, spark.createDataFrame(rows, schema).repartition(4)


def least_value(values, f):
    values = sorted(values)
    return next(v for k, v in enumerate(values, 1) if k >= f * len(values))


def test_small_groups_are_exact_for_any_window(spark):
    rows, df = fact(spark, 3000, ["a", "b", None])
    sketches = S.day_sketches(df, ["lane"])
    for start, end in ((None, None), (DAY, DAY + dt.timedelta(days=7)), (DAY + dt.timedelta(days=5), None)):
        found = S.calibrate_sketched(sketches, ["lane"], (0.9, 0.5), start, end).collect()
        kept = [r for r in rows if (not start or r[2] >= start) and (not end or r[2] < end)]
        want = {}
        for lane in {r[0] for r in kept}:
            own = [r[3] for r in kept if r[0] == lane]
            want[lane] = (len(own), least_value(own, 0.5), least_value(own, 0.9))
        assert {r["lane"]: (r["n_train"], r["promise_50"], r["promise_90"]) for r in found} == want


def test_rank_error_is_held(spark):
    rows, df = fact(spark, 60_000, ["hot"])
    k = 200
    sketches = S.day_sketches(df, ["lane"], k=k)
    found = S.calibrate_sketched(sketches, ["lane"], (0.5, 0.9, 0.95)).first()
    values = [r[3] for r in rows]
    for f, name in ((0.5, "promise_50"), (0.9, "promise_90"), (0.95, "promise_95")):
        below = sum(v < found[name] for v in values) / len(values)
        upto = sum(v <= found[name] for v in values) / len(values)
        assert below - 2 * S.rank_error(k) <= f <= upto + 2 * S.rank_error(k)
    assert S.rank_error(4096) < 0.001


def test_few_orders_nulls_and_coarser_keys(spark):
    rows = [("a", "s", DAY, 3), ("a", "s", DAY, None), ("b", "s", DAY, 5), ("b", "s", DAY, 9)]
    df = spark.createDataFrame(rows, "lane string, customer_state string, purchase_date date, total_days int")
    sketches = S.day_sketches(df, ["lane", "customer_state"])
    by_lane = S.calibrate_sketched(sketches, ["lane"], (0.95,), min_orders=2).collect()
    assert [tuple(r) for r in by_lane] == [("b", 2, 9)]
    by_state = S.calibrate_sketched(sketches, ["customer_state"], (0.5,)).collect()
    assert [tuple(r) for r in by_state] == [("s", 3, 5)]
    assert S.calibrate_sketched(sketches, ["lane"], (0.5,), end=DAY).collect() == []
    with pytest.raises(ValueError):
        S.calibrate_sketched(sketches, ["lane"], ())
