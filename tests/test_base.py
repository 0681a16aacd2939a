import datetime as dt

from frames import frame, order, simple_order, sources
from lanecast.operators import lead_time, quality
from lanecast.plans import REPORTS, Marts
from lanecast.settings import MARKETPLACE


def base(spark, rows):
    return lead_time.build_base(frame(spark, "orders", rows), MARKETPLACE)


def test_three_notions_of_late(spark):
    day = "2018-01-20"
    rows = [
        order("same day", "2018-01-10 09:00:00", "2018-01-10 10:00:00", "2018-01-11 09:00:00", f"{day} 10:00:00", f"{day} 00:00:00"),
        order("midnight", "2018-01-10 09:00:00", "2018-01-10 10:00:00", "2018-01-11 09:00:00", f"{day} 00:00:00", f"{day} 00:00:00"),
        order("no promise", "2018-01-10 09:00:00", "2018-01-10 10:00:00", "2018-01-11 09:00:00", f"{day} 10:00:00", None),
    ]
    got = {r.order_id: (r.is_late, r.promise_error_days, r.total_days) for r in base(spark, rows).collect()}
    assert got == {
        "same day": (True, 0, 10),
        "midnight": (False, 0, 10),
        "no promise": (None, None, 10),
    }


def test_gap_filter_is_signed_and_suspects_stay(spark):
    scan = dt.datetime(2018, 1, 10, 9, 0)
    bought, arrived, due = "2018-01-10 08:00:00", "2018-01-25 08:00:00", "2018-01-30 00:00:00"
    rows = [
        order(f"{h}", bought, str(scan + dt.timedelta(hours=h)), str(scan), arrived, due)
        for h in (-500, 1, 168, 169)
    ]
    got = {r.order_id: r.approval_suspect for r in base(spark, rows).collect()}
    assert got == {"-500": False, "1": True, "168": True}


def test_window_status_and_completeness(spark):
    rows = [
        simple_order("first", bought="2017-01-01 00:00:00"),
        simple_order("before", bought="2016-12-31 23:59:59"),
        simple_order("last", bought="2018-08-31 23:59:59"),
        simple_order("after", bought="2018-09-01 00:00:00"),
        simple_order("canceled", status="canceled"),
    ]
    for name, column in [("a", "order_approved_at"), ("s", "order_delivered_carrier_date"), ("d", "order_delivered_customer_date")]:
        rows.append({**simple_order(name), column: None})
    assert {r.order_id for r in base(spark, rows).collect()} == {"first", "last"}


def test_segments_add_up_to_the_hours_end_to_end(spark):
    rows = [simple_order(str(i), days=i % 9, bought=f"2018-01-10 0{i}:59:30") for i in range(9)]
    segments = lead_time.with_segments(base(spark, rows)).collect()
    for r in segments:
        hours = r.approval_hours + r.handoff_hours + r.transit_hours
        start = r.purchased_at.replace(minute=0, second=0)
        end = r.delivered_at.replace(minute=0, second=0)
        assert hours == (end - start).total_seconds() / 3600


def test_funnel_shrinks_and_counts_nulls_as_out(spark):
    rows = [simple_order("1"), simple_order("2", status="canceled"), {**simple_order("3"), "order_status": None}]
    marts = Marts(sources(spark, orders=rows))
    got = [(r.stage, r.n) for r in REPORTS["base_funnel"](marts).collect()]
    assert got == [("all orders", 3), ("delivered", 1), ("final base", 1)]


def test_bands_cover_every_row_and_shares_total_100(spark):
    rows = [simple_order(str(i), days=i) for i in range(40)] + [
        {**simple_order("none"), "order_estimated_delivery_date": None}
    ]
    marts = Marts(sources(spark, orders=rows))
    got = REPORTS["promise_error_bands"](marts).collect()
    assert sum(r.n_orders for r in got) == 41
    assert abs(sum(r.pct for r in got) - 100) < 1e-9
    assert [r.bucket for r in got] == sorted(r.bucket for r in got)


def test_empty_input_gives_null_figures(spark):
    marts = Marts(sources(spark))
    row = REPORTS["base_headline"](marts).first()
    assert row.mean_days is None and row.median_days is None
    assert REPORTS["violation_gap_summary"](marts).first().n_orders == 0


def test_violations_and_completeness(spark):
    rows = [
        order("1", "2018-01-10 09:00:00", "2018-01-10 08:00:00", "2018-01-10 07:00:00", "2018-01-10 06:00:00", None),
        simple_order("2"),
        {**simple_order("3"), "order_approved_at": None},
    ]
    df = frame(spark, "orders", rows)
    steps = [("a", "order_purchase_timestamp", "order_approved_at"), ("b", "order_approved_at", "order_delivered_carrier_date")]
    assert tuple(quality.order_violations(df, steps).first()) == (1, 1)
    counts = quality.completeness(df, "n", {"approved": "order_approved_at", "due": "order_estimated_delivery_date"})
    assert tuple(counts.first()) == (3, 2, 2)
