import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frames import ts
from lanecast.functions import (
    GAP_BANDS,
    PROMISE_BANDS,
    REVIEW_BANDS,
    Band,
    band,
    day_diff,
    hour_boundaries,
    month_label,
    pct,
    shown,
)


def pairs(spark, rows):
    return spark.createDataFrame([(ts(a), ts(b)) for a, b in rows], "a timestamp_ntz, b timestamp_ntz")


def test_boundaries_are_counted_not_elapsed_time(spark):
    rows = [
        ("2018-01-01 23:59:00", "2018-01-02 00:01:00"),
        ("2018-01-02 00:01:00", "2018-01-01 23:59:00"),
        ("2018-01-01 10:59:00", "2018-01-01 11:01:00"),
        ("2018-01-01 11:01:00", "2018-01-01 10:59:00"),
        ("2018-01-01 10:00:00", "2018-01-01 10:59:59"),
        (None, "2018-01-01 10:59:59"),
    ]
    got = pairs(spark, rows).select(day_diff("a", "b"), hour_boundaries("a", "b")).collect()
    assert [tuple(r) for r in got] == [(1, 1), (-1, -1), (0, 1), (0, -1), (0, 0), (None, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def test_session_zone_does_not_matter(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("2017-10-14 23:30:00", "2017-10-15 01:10:00"), ("2018-02-17 22:59:00", "2018-02-18 00:00:00")]
        got = pairs(spark, rows).select(
            day_diff("a", "b"), hour_boundaries("a", "b"), month_label("b")
        ).collect()
        assert [tuple(r) for r in got] == [(1, 2, "2017-10"), (1, 2, "2018-02")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


moments = st.datetimes(dt.datetime(2016, 1, 1), dt.datetime(2019, 1, 1))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(moments, moments), min_size=50, max_size=80))
def test_hours_equal_truncated_difference(spark, rows):
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(hour_boundaries("a", "b")).collect()]

    def hour(t):
        return t.replace(minute=0, second=0, microsecond=0)

    assert got == [int((hour(b) - hour(a)).total_seconds()) // 3600 for a, b in rows]


def labels(spark, bands, values, closed="right"):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    return [r[0] for r in df.select(band("x", bands, closed)).collect()]


def test_promise_band_edges(spark):
    got = labels(spark, PROMISE_BANDS, [-21, -20, -19, -10, -9, -5, -4, -1, 0, 1, 5, 6, None])
    assert [x[0] for x in got] == list("aabbccddeffgg")


def test_review_and_gap_band_edges(spark):
    got = labels(spark, REVIEW_BANDS, [-20, -10, -9, -1, 0, 3, 4, 7, 8, 14, 15])
    assert [x[0] for x in got] == list("aabbcdeeffg")
    got = labels(spark, GAP_BANDS, [0, 6, 7, 24, 25, 72, 73, 168, 169])
    assert [x[0] for x in got] == list("aabbccdde")


def test_left_closed_bands(spark):
    bands = (Band("low", 0), Band("mid", 10), Band("high", None))
    assert labels(spark, bands, [-1, 0, 9, 10], "left") == ["low", "mid", "mid", "high"]
    with pytest.raises(ValueError):
        band("x", bands, "both")


def test_ratios_and_rounding(spark):
    row = spark.sql("SELECT 0L AS zero, 3L AS three, 7L AS seven, 71.085D AS tie, -0.25D AS neg").select(
        pct(F.col("three"), F.col("zero")).alias("none"),
        pct(F.col("three"), F.col("seven")).alias("some"),
        shown(F.col("tie"), 2).alias("tie"),
        shown(F.col("neg"), 1).alias("neg"),
    ).first()
    assert row.none is None and row.some == 300.0 / 7
    assert (row.tie, row.neg) == (71.08, -0.3)
