"""Every registered report against its SQL, value by value."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as contract
from lanecast.plans import DERIVED, REPORTS

FOLDERS = {"small": "/root/testdata/sf0.001", "check": "/root/testdata/sf0.01"}
TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]
EVERY, EVERY_SQL = contract.queries(), contract.oracle_sql()
NAMES = [*REPORTS, *DERIVED]
QUERIES, SQL = {n: EVERY[n] for n in NAMES}, {n: EVERY_SQL[n] for n in NAMES}


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(table, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_report_has_sql():
    assert len(QUERIES) == 72
    assert set(EVERY_SQL) <= set(EVERY)


@pytest.mark.parametrize("name", QUERIES)
def test_report_matches_sql(spark, name):
    folder = FOLDERS["check"]
    answer = connect(folder).sql(SQL[name])
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(answer.columns)
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
    want = {c: kinds[str(t)] for c, t in zip(answer.columns, answer.types)}
    assert dict(df.dtypes) == want
    expected = sorted_rows(answer.columns, answer.fetchall())
    assert expected, "the check needs rows"
    assert sorted_rows(df.columns, df.collect()) == expected


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r.policy for r in rows] == ["current", "recal_p90", "recal_p92", "recal_p95"]
