"""Explicit schemas of the marketplace tables and the check against them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_text, _time, _real, _int = StringType(), TimestampNTZType(), DoubleType(), IntegerType()

# Column names and order of the public marketplace files.
SCHEMAS: dict[str, StructType] = {
    "orders": _schema(
        order_id=_text,
        customer_id=_text,
        order_status=_text,
        order_purchase_timestamp=_time,
        order_approved_at=_time,
        order_delivered_carrier_date=_time,
        order_delivered_customer_date=_time,
        order_estimated_delivery_date=_time,
    ),
    "customers": _schema(
        customer_id=_text,
        customer_unique_id=_text,
        customer_zip_code_prefix=_text,
        customer_city=_text,
        customer_state=_text,
    ),
    "sellers": _schema(
        seller_id=_text,
        seller_zip_code_prefix=_text,
        seller_city=_text,
        seller_state=_text,
    ),
    "items": _schema(
        order_id=_text,
        order_item_id=_int,
        product_id=_text,
        seller_id=_text,
        shipping_limit_date=_time,
        price=_real,
        freight_value=_real,
    ),
    "products": _schema(
        product_id=_text,
        product_category_name=_text,
        product_name_lenght=_int,
        product_description_lenght=_int,
        product_photos_qty=_int,
        product_weight_g=_real,
        product_length_cm=_real,
        product_height_cm=_real,
        product_width_cm=_real,
    ),
    "translation": _schema(
        product_category_name=_text,
        product_category_name_english=_text,
    ),
    "reviews": _schema(
        review_id=_text,
        order_id=_text,
        review_score=_int,
        review_comment_title=_text,
        review_comment_message=_text,
        review_creation_date=_time,
        review_answer_timestamp=_time,
    ),
    "payments": _schema(
        order_id=_text,
        payment_sequential=_int,
        payment_type=_text,
        payment_installments=_int,
        payment_value=_real,
    ),
}

_TYPED = ("timestamp_ntz", "double", "int")


def conform(
    df: DataFrame,
    table: str,
    mapping: Mapping[str, str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rename columns (``mapping``: standard name -> column in ``df``) and check types.

    Keys may have any type; timestamps and measures must have the table's, and a
    missing column is an error before any job starts.  Columns that no report
    reads may be absent; ``keep`` names further ones to carry along.
    """
    mapping = dict(mapping or {})
    present = {name.lower(): name for name in df.columns}
    chosen, problems = [], []
    for field in SCHEMAS[table].fields:
        source = mapping.get(field.name, field.name)
        if source.lower() not in present:
            if field.name in REQUIRED[table]:
                problems.append(f"{field.name}: no column {source}")
            continue
        have = df.schema[present[source.lower()]].dataType.simpleString()
        want = field.dataType.simpleString()
        money = want == "double" and have.startswith("decimal")
        if want in _TYPED and have != want and not money:
            problems.append(f"{field.name}: {have}, expected {want}")
        chosen.append(F.col(present[source.lower()]).alias(field.name))
    if problems:
        raise ValueError(f"{table} does not conform: " + "; ".join(problems))
    return df.select(*chosen, *keep)


# The columns the reports read.
REQUIRED: dict[str, frozenset[str]] = {
    "orders": frozenset(SCHEMAS["orders"].names),
    "customers": frozenset(SCHEMAS["customers"].names),
    "sellers": frozenset(SCHEMAS["sellers"].names),
    "items": frozenset({"order_id", "seller_id", "product_id", "shipping_limit_date", "price"}),
    "products": frozenset({"product_id", "product_category_name", "product_weight_g"}),
    "translation": frozenset(SCHEMAS["translation"].names),
    "reviews": frozenset({"review_id", "order_id", "review_score", "review_creation_date"}),
    "payments": frozenset({"order_id", "payment_value"}),
}
