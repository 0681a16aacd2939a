"""Operators in their general form: chains, key sets, key audits, frames, free thresholds, the entry's guard."""

import datetime as dt
import pathlib
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecast.operators import calibration as cal
from lanecast.operators import distribution as dist
from lanecast.operators import lead_time, outcomes, star
from lanecast.plans import Marts
from lanecast.settings import TPCH
from lanecast.sources import TpchSources

FOLDER = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def marts(spark):
    return Marts(TpchSources(spark, FOLDER), TPCH)


# Chains


def test_three_steps_equal_the_fixed_segments(marts):
    steps = {"a": "purchased_at", "b": "approved_at", "c": "shipped_at", "d": "delivered_at"}
    events = lead_time.base_events(marts.base, steps)
    for unit in ("hour", "day"):
        got = lead_time.chain_segments(events, list(steps), unit)
        got = got.groupBy("order_id").pivot("to_step", ["b", "c", "d"]).agg(F.first("length"))
        fixed = marts.segments if unit == "hour" else marts.segment_days
        columns = [f"{s}_{unit}s" for s in lead_time.SEGMENTS]
        want = fixed.select("order_id", *columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


EVENTS = "order_id string, step string, at timestamp_ntz"


def event(order, step, text):
    return (order, step, dt.datetime.fromisoformat(text) if text else None)


def test_a_five_step_chain_telescopes_over_gaps(spark):
    rows = [
        event("o", "e", "2020-01-09 00:10:00"), event("o", "a", "2020-01-01 23:50:00"),
        event("o", "b", "2020-01-03 10:00:00"), event("o", "b", "2020-01-02 00:10:00"),
        event("o", "d", "2020-01-01 12:00:00"), event("o", "other", "2020-01-05 00:00:00"),
        event("o", "c", None), event(None, "a", "2020-01-01 00:00:00"), event("single", "a", "2020-01-01 00:00:00"),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    found = lead_time.chain_segments(df, ["a", "b", "c", "d", "e"], "hour").orderBy("from_step").collect()
    assert [(r["from_step"], r["to_step"], r["length"], r["n_skipped"]) for r in found] == [
        ("a", "b", 1, 0), ("b", "d", -12, 1), ("d", "e", 180, 0),
    ]
    assert sum(r["length"] for r in found) == 8 * 24 - 23
    minutes = lead_time.chain_segments(df, ["a", "b"], "minute").collect()
    assert [tuple(r) for r in minutes] == [("o", "a", "b", 20, 0)]
    with pytest.raises(ValueError):
        lead_time.chain_segments(df, ["a", "a"])
    with pytest.raises(ValueError):
        lead_time.chain_segments(df, ["a", "b"], "week")


# Key sets


def test_key_sets_equal_separate_runs_and_the_definition(spark):
    rng = random.Random(4)
    rows = [
        (rng.choice(["x", "y", None]), rng.choice(["m", "n"]), rng.choice([1, 2, None]), rng.randrange(-50, 500))
        for _ in range(500)
    ]
    df = spark.createDataFrame(rows, "city string, state string, month int, hours long")
    sets = {"city": "city", "both": ["state", "month"], "all": ["month", "city", "state"], "again": ["city"]}
    got = dist.variance_explained(df, "hours", sets).first()
    place = {"city": 0, "state": 1, "month": 2}
    whole = [r for r in rows if None not in r[:3]]
    assert got["n_orders"] == len(whole)
    assert got["total_variance"] == pytest.approx(np.var([r[3] for r in whole]), rel=1e-12)
    for name, key in sets.items():
        columns = [key] if isinstance(key, str) else key
        of = lambda r: tuple(r[place[c]] for c in columns)  # noqa: B023, E731
        middle = {k: np.median([r[3] for r in rows if of(r) == k]) for k in {of(r) for r in whole}}
        want = np.var([r[3] - middle[of(r)] for r in whole])
        assert got[f"within_{name}"] == pytest.approx(want, rel=1e-12), name
    none = dist.variance_explained(df.where("false"), "hours", sets).first()
    assert none["n_orders"] == 0 and none["within_both"] is None
    for bad in ({}, {"k": []}):
        with pytest.raises(ValueError):
            dist.variance_explained(df, "hours", bad)


def test_key_sets_read_the_input_once(marts):
    fact = lead_time.trusted(marts.fact)
    sets = {"dest": "customer_state", "lane": ["seller_state", "customer_state"]}
    plan = dist.variance_explained(fact, "transit_hours", sets)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Final Plan")[0] and plan.count("Expand") == 1


# Keys behind an integrity failure


def test_every_kind_of_fault_is_named(spark):
    base = spark.createDataFrame([(k,) for k in [1, 2, 3, 3, 4, 5]] + [(None,)], "order_id long")
    fact = spark.createDataFrame([(k,) for k in [2, 3, 4, 4, 4, 9]] + [(None,)] * 2, "order_id long")
    found = {r["kind"]: (r["n_keys"], r["n_rows"], r["keys"]) for r in star.integrity_keys(base, fact, "order_id", 2).collect()}
    assert found == {
        "lost": (2, 2, [1, 5]),
        "foreign": (1, 1, [9]),
        "doubled": (1, 2, [3]),
        "fanned_out": (2, 5, [None, 4]),
    }
    clean = star.integrity_keys(base.distinct(), base.distinct(), "order_id")
    assert clean.collect() == []


def test_the_refusal_names_the_keys(marts):
    doubled = marts.fact.union(marts.fact.orderBy("order_id").limit(1))
    first = marts.fact.orderBy("order_id").first()["order_id"]
    with pytest.raises(ValueError, match=f"fanned_out: 1 keys, first \\[{first}\\]"):
        star.require_integrity(marts.base, doubled, "order_id")


def test_the_list_of_keys_is_bounded(spark):
    base = spark.range(5000).withColumnRenamed("id", "k")
    found = star.integrity_keys(base, base.where("false"), "k", 3).collect()
    assert [tuple(r) for r in found] == [("lost", 5000, 5000, [0, 1, 2])]


# Follow-ups by a frame


def test_frame_equals_join(spark):
    rng = random.Random(9)
    day = lambda: dt.date(2018, 1, 1) + dt.timedelta(days=rng.randrange(200))
    days = [(p, day(), rng.randrange(1, 4)) for p in [None, *range(40)] for _ in range(rng.randrange(0, 12))]
    days = list({(p, d): (p, d, n) for p, d, n in days}.values())
    firsts = [(p, day(), rng.random() < 0.5) for p in range(0, 60)]
    per_day = spark.createDataFrame(days, "person long, day date, n long")
    first = spark.createDataFrame(firsts, "person long, purchase_date date, is_late boolean")
    ask = ("person", 30, dt.date(2018, 6, 1))
    by_join = outcomes.followup_within(first, per_day, *ask)
    by_frame = outcomes.followup_by_frame(first, per_day, *ask)
    assert sorted(map(tuple, by_frame.collect())) == sorted(map(tuple, by_join.collect()))
    assert "Join" not in by_frame._jdf.queryExecution().executedPlan().toString()


def test_one_person_with_very_many_days(spark):
    per_day = spark.range(200_000).select(
        F.lit(1).cast("long").alias("person"), F.date_add(F.lit(dt.date(1600, 1, 1)), F.col("id").cast("int")).alias("day"),
        F.lit(1).cast("long").alias("n"),
    )
    first = spark.createDataFrame([(1, dt.date(1700, 1, 1), True)], "person long, purchase_date date, is_late boolean")
    found = outcomes.followup_by_frame(first, per_day, "person", 90, dt.date(2018, 1, 1)).collect()
    assert [tuple(r) for r in found] == [(1, True, 90)]


# Free thresholds


def test_ten_thousand_thresholds_and_the_whole_curve(spark):
    cut = dt.date(2018, 3, 1)
    rng = random.Random(2)
    rows = []
    for lane in [None, *(f"l{k}" for k in range(60))]:
        rows += [(lane, dt.date(2018, 1, 1))] * rng.randrange(0, 90) + [(lane, dt.date(2018, 4, 1))] * rng.randrange(0, 9)
    fact = spark.createDataFrame(rows, "lane string, purchase_date date")
    past, future = {}, {}
    for lane, day in rows:
        of = past if day < cut else future
        of[lane] = of.get(lane, 0) + 1
    total = sum(future.values())

    def want(t):
        lanes = [lane for lane, n in past.items() if n >= t]
        served = sum(future.get(lane, 0) for lane in lanes if lane is not None) if lanes else None
        return (t, len(lanes), served, None if served is None else pytest.approx(100 * served / total))

    asked = list(range(-2, 9998))
    found = [tuple(r) for r in cal.threshold_coverage(fact, cut, asked + [5, 5]).collect()]
    assert found == [want(t) for t in asked]
    curve = [tuple(r) for r in cal.threshold_coverage(fact, cut).collect()]
    assert curve == [want(t) for t in sorted(set(past.values()))]
    assert cal.threshold_coverage(fact.where("false"), cut, [1]).collect() == []


# The entry's guard


@pytest.mark.parametrize("blocked", ["zstandard", "lanecast.llm", "corpus_pipeline"])
def test_reports_stay_when_a_text_dependency_is_missing(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    queries, sql = map(int, done.stdout.split()[-2:])
    if blocked == "corpus_pipeline":
        assert queries >= 72
    else:
        assert (queries, sql) == (72, 72)
