import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanecast.operators import distribution as dist

small = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
group_values = st.dictionaries(
    st.sampled_from(["a", "b", "c"]), st.lists(st.integers(-300, 900), min_size=1, max_size=40), min_size=1
)


def rows_of(groups):
    return [(k, v) for k, values in groups.items() for v in values]


@small
@given(group_values)
def test_counted_quantiles_and_deviation_equal_numpy(spark, groups):
    df = spark.createDataFrame(rows_of(groups), "k string, x long")
    counted = dist.value_counts(df, ["x"], ["k"])
    got = counted.groupBy("k").agg(
        dist.quantiles(F.col("value"), 0.5, 0.9, 0.95).alias("q"),
        *[c.alias(n) for n, c in dist.moments().items()],
    ).withColumns({
        "pop": dist.variance(F.col("size"), F.col("total"), F.col("squares")),
        "sample": dist.variance(F.col("size"), F.col("total"), F.col("squares"), sample=True),
    }).collect()
    assert len(got) == len(groups)
    for r in got:
        x = np.array(groups[r.k])
        assert r.q == pytest.approx(list(np.quantile(x, [0.5, 0.9, 0.95])), abs=1e-9)
        assert r["pop"] == pytest.approx(x.var(), rel=1e-12, abs=1e-12)
        if len(x) == 1:
            assert r["sample"] is None
        else:
            assert r["sample"] == pytest.approx(x.var(ddof=1), rel=1e-12, abs=1e-12)


def test_null_measures_count_as_rows_but_not_as_values(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", None, None), ("a", 3, False)], "k string, x long, f boolean")
    counted = dist.value_counts(df, ["x"], ["k"], "f")
    got = counted.agg(
        F.sum("n").alias("n"), dist.quantiles(F.col("value"), 0.5).alias("q"),
        F.sum("n_flag").alias("hit"), F.sum("n_flag_known").alias("known"),
    ).first()
    assert (got.n, got.q, got.hit, got.known) == (3, [2.0], 1, 2)


@small
@given(group_values)
def test_variance_explained_equals_rowwise_definition(spark, groups):
    rows = rows_of(groups) + [(None, 5), (None, 700)]
    df = spark.createDataFrame(rows, "k string, x long")
    got = dist.variance_explained(df, "x", {"k": "k"}).first()
    x = np.concatenate([np.array(v, float) for v in groups.values()])
    rest = np.concatenate([np.array(v, float) - np.median(v) for v in groups.values()])
    assert got.n_orders == len(x)
    assert got.total_variance == pytest.approx(x.var(), rel=1e-12, abs=1e-12)
    assert got.within_k == pytest.approx(rest.var(), rel=1e-12, abs=1e-12)


def test_two_keys_use_medians_of_all_rows(spark):
    rows = [("s", "l1", 10), ("s", "l2", 30), ("s", None, 50), ("t", "l3", 7)]
    df = spark.createDataFrame(rows, "state string, lane string, x long")
    got = dist.variance_explained(df, "x", {"dest": "state", "lane": "lane"}).first()
    assert got.n_orders == 3
    assert got.total_variance == pytest.approx(np.var([10, 30, 7]))
    assert got.within_dest == pytest.approx(np.var([-20, 0, 0]))
    assert got.within_lane == 0


def test_sums_survive_huge_counts(spark):
    big = 10**12
    df = spark.createDataFrame([(0, big), (20_000, big)], "value long, n long")
    sums = df.agg(*[c.alias(n) for n, c in dist.moments().items()])
    got = sums.select(dist.variance(F.col("size"), F.col("total"), F.col("squares"))).first()[0]
    assert got == 1e8


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    assert {r.k: r.p for r in dist.share_of_total(df, "n", "p").collect()} == {"a": 25.0, "b": 75.0}


def test_distribution_by_key(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("b", 5, None)], "k string, x long, y long")
    got = dist.distribution(df, ["x", "y"], {"median": 0.5, "p95": 0.95}, ["k"])
    rows = {(r.k, r.measure): (r.n, r.mean, r.median, r.stddev) for r in got.collect()}
    assert rows == {
        ("a", "x"): (2, 2.0, 2.0, 2**0.5),
        ("a", "y"): (2, 20.0, 20.0, 200**0.5),
        ("b", "x"): (1, 5.0, 5.0, None),
        ("b", "y"): (0, None, None, None),
    }


def test_continuous_measures_are_refused(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    with pytest.raises(TypeError, match="whole number"):
        dist.value_counts(df, ["x"])


def test_first_per_key(spark):
    rows = [("a", 2, "late"), ("a", 1, "early"), ("b", None, "only"), (None, 7, "nobody")]
    df = spark.createDataFrame(rows, "k string, t long, v string")
    got = {r.k: r.v for r in dist.first_per_key(df, "k", ["t"], ["v"]).collect()}
    assert got == {"a": "early", "b": "only", None: "nobody"}
