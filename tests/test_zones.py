"""The session's time zone must not change any row."""

import pytest

from test_oracle import FOLDERS, QUERIES, SQL, connect, sorted_rows


@pytest.mark.parametrize("name", ["monthly_volume", "fct_orders", "order_origin", "repeat_within_90d"])
def test_reports_in_another_zone(spark, name):
    folder = FOLDERS["small"]
    answer = connect(folder).sql(SQL[name])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = QUERIES[name](spark, folder)
        got = sorted_rows(df.columns, df.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == sorted_rows(answer.columns, answer.fetchall())
