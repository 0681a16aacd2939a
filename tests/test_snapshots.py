import pytest
from pyspark.sql import functions as F

from lanecast.plans import REPORTS, Marts
from lanecast.plans.marts import read_table
from lanecast.plans.snapshots import Snapshots
from lanecast.settings import TPCH
from lanecast.sources import TpchSources

FOLDER = "/root/testdata/sf0.001"


def marts(spark, store=None):
    return Marts(TpchSources(spark, FOLDER), TPCH, store=store)


def write(snapshots, tables, spark):
    run, schemas = snapshots.begin(), {}
    for name, n in tables.items():
        df = spark.range(n)
        df.write.parquet(snapshots.place(run, name))
        schemas[name] = df.schema
    return snapshots.commit(run, schemas)


def test_a_run_that_fails_between_tables_leaves_the_old_set_whole(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    kept = marts(spark, store=f"{out}/store")
    assert kept.publish(f"{out}/tables") == 1
    before = {n: read_table(spark, f"{out}/tables", n).count() for n in Marts.TABLES}
    whole = kept.tables()

    def broken():
        fails = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("order_id"))
        return {n: fails if k == 5 else df.limit(1) for k, (n, df) in enumerate(whole.items())}

    monkeypatch.setattr(kept, "tables", broken)
    with pytest.raises(Exception, match="lost"):
        kept.publish(f"{out}/tables")
    snapshots = Snapshots(spark, f"{out}/tables")
    assert snapshots.versions() == [1]
    assert {n: read_table(spark, f"{out}/tables", n).count() for n in Marts.TABLES} == before
    # What the failed run left goes with the clean-up; the published set stays.
    assert len(snapshots.expire(keep=1, unfinished_hours=0)) == 1
    assert {n: read_table(spark, f"{out}/tables", n).count() for n in Marts.TABLES} == before


def test_readers_keep_the_version_they_resolved(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        snapshots.manifest()
    assert snapshots.versions() == []
    assert write(snapshots, {"a": 3, "b": 0}, spark) == 1
    old = snapshots.read("a")
    assert write(snapshots, {"a": 5, "b": 1}, spark) == 2
    assert (old.count(), snapshots.read("a").count(), snapshots.read("a", 1).count()) == (3, 5, 3)
    assert snapshots.read("b", 1).columns == ["id"] and snapshots.read("b", 1).count() == 0
    with pytest.raises(KeyError):
        snapshots.read("c")


def test_publishers_at_once_get_different_numbers(spark, tmp_path, monkeypatch):
    first, second = Snapshots(spark, str(tmp_path)), Snapshots(spark, str(tmp_path))
    assert write(first, {"a": 1}, spark) == 1
    monkeypatch.setattr(second, "versions", lambda: [])  # it listed before the first committed
    assert write(second, {"a": 2}, spark) == 2
    assert first.read("a").count() == 2


def test_old_versions_expire(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path))
    for n in range(1, 5):
        write(snapshots, {"a": n}, spark)
    young = snapshots.begin()
    spark.range(1).write.parquet(snapshots.place(young, "a"))
    assert len(snapshots.expire(keep=2)) == 2
    assert snapshots.versions() == [3, 4]
    assert [snapshots.read("a", v).count() for v in (3, 4)] == [3, 4]
    assert (tmp_path / "data" / young).exists()
    with pytest.raises(ValueError):
        snapshots.expire(keep=0)


def test_promises_scan_the_training_months_only(spark, tmp_path):
    from lanecast.sources import land, read_landed

    land(TpchSources(spark, FOLDER), str(tmp_path))
    landed = read_landed(spark, str(tmp_path))
    for name in ("lane_promise", "state_promise", "national_promise"):
        df = REPORTS[name](Marts(landed, TPCH))
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "purchase_month" in line]
        assert filters and all("1999-06" in line and "2001" not in line.split("PartitionFilters")[1] for line in filters), name
        want = REPORTS[name](marts(spark))
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
