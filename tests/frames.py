"""Hand-made source frames for unit tests."""

import datetime as dt

from lanecast.sources import SCHEMAS, Sources


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


def frame(spark, table, rows):
    """Rows as dicts; columns that are left out are NULL."""
    schema = SCHEMAS[table]
    data = []
    for row in rows:
        unknown = set(row) - set(schema.names)
        assert not unknown, unknown
        data.append(
            tuple(
                ts(row[f.name])
                if f.dataType.simpleString() == "timestamp_ntz" and isinstance(row.get(f.name), str)
                else row.get(f.name)
                for f in schema.fields
            )
        )
    return spark.createDataFrame(data, schema)


def order(order_id, bought, approved, shipped, delivered, promised, customer="c1", status="delivered"):
    return {
        "order_id": order_id,
        "customer_id": customer,
        "order_status": status,
        "order_purchase_timestamp": bought,
        "order_approved_at": approved,
        "order_delivered_carrier_date": shipped,
        "order_delivered_customer_date": delivered,
        "order_estimated_delivery_date": promised,
    }


def simple_order(order_id, bought="2018-01-10 09:00:00", days=5, promised_days=10, **kwargs):
    start = ts(bought)
    midnight = dt.datetime.combine(start.date(), dt.time())
    return order(
        order_id,
        bought,
        str(start + dt.timedelta(hours=1)),
        str(start + dt.timedelta(hours=20)),
        str(start + dt.timedelta(days=days)),
        str(midnight + dt.timedelta(days=promised_days)),
        **kwargs,
    )


def sources(spark, **tables):
    return Sources(**{t: frame(spark, t, tables.get(t, [])) for t in SCHEMAS})
