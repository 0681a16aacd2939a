import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanecast.operators import selection as S

MARKS = {"low": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "p999": 0.999, "high": 1.0}


def answer(df, keys, **other):
    found = S.exact_quantiles(df, "x", MARKS, keys, **other)
    assert found.columns == [*keys, "n", "mean", *MARKS]
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found.collect()]
    return sorted(rows, key=str)


def expected(pdf, keys):
    con = duckdb.connect()
    con.register("t", pdf)
    by = ", ".join(keys)
    marks = ", ".join(f"quantile_cont(x, {f})" for f in MARKS.values())
    head, tail = (f"{by}, ", f"GROUP BY {by}") if keys else ("", "")
    rows = con.sql(f"SELECT {head} count(x), avg(x), {marks} FROM t WHERE x IS NOT NULL {tail}").fetchall()
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=str)


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    rows = []
    for k in range(30_000):
        group = "hot" if k % 3 else rng.choice(["a", "b", None, f"s{k % 200}"])
        x = rng.choice([rng.gauss(0, 1) * 10 ** rng.randrange(6), 7.25, float(rng.randrange(50))])
        rows.append((group, k % 2, x if rng.random() > 0.02 else None))
    return pd.DataFrame(rows, columns=["g", "h", "x"])


@pytest.fixture(scope="module")
def frame(spark, values):
    rows = [(g, h, None if pd.isna(x) else x) for g, h, x in values.itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, h long, x double").repartition(7)


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
def test_equals_quantile_cont(frame, values, keys):
    assert answer(frame, keys) == expected(values, keys)


@pytest.mark.parametrize("accuracy", [1, 3, 50])
def test_brackets_that_miss_are_read_again(frame, values, accuracy, monkeypatch):
    monkeypatch.setattr(S, "MARGIN", 0.0)  # every bracket is a single guess
    assert answer(frame, ["g"], accuracy=accuracy) == expected(values, ["g"])


def test_other_numbers_and_strange_names(spark):
    rows = [("k", 1, 5), ("k", 2, 7), ("k", None, 9)]
    df = spark.createDataFrame(rows, "`a.b` string, `the x` int, n long")
    found = S.exact_quantiles(df, "the x", {"q": 0.5}, ["a.b"]).collect()
    assert [tuple(r) for r in found] == [("k", 2, 1.5, 1.5)]
    money = spark.createDataFrame([(1, "1.25"), (1, "2.50")], "g int, x string").select(
        "g", F.col("x").cast("decimal(10,2)")
    )
    assert S.exact_quantiles(money, "x", {"q": 0.5}, ["g"]).first()["q"] == 1.875


def test_no_values_and_bad_fractions(spark):
    empty = spark.createDataFrame([("a", None)], "g string, x double")
    assert S.exact_quantiles(empty, "x", MARKS, ["g"]).collect() == []
    assert S.exact_quantiles(empty, "x", MARKS).collect() == []
    for bad in ({}, {"q": 1.5}, {"q": -0.1}):
        with pytest.raises(ValueError):
            S.exact_quantiles(empty, "x", bad)


def test_one_key_of_a_million_values_moves_few_of_them(spark, tmp_path):
    """The values that are gathered for ranks are a small part of the group."""
    df = spark.range(1_000_000, numPartitions=8).select(
        F.lit("one").alias("g"), (F.xxhash64("id") / F.lit(2.0**40)).alias("x")
    )
    kept = []
    whole = S.freeze

    def watched(frame, name):
        out = whole(frame, name)
        if name.startswith("selection"):
            kept.append(out.count())
        return out

    S.freeze = watched
    try:
        found = S.exact_quantiles(df, "x", {"median": 0.5, "p95": 0.95}, ["g"]).first()
    finally:
        S.freeze = whole
    assert len(kept) == 1 and kept[0] < 4_000
    df.select("x").write.parquet(str(tmp_path / "x"))
    want = duckdb.sql(f"SELECT quantile_cont(x, [0.5, 0.95]) FROM '{tmp_path}/x/*.parquet'").fetchall()[0][0]
    assert [found["median"], found["p95"]] == pytest.approx(want, rel=1e-12)
