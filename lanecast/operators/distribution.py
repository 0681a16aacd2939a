"""Exact distributions from counted values.

Measures are whole hours or days, so rows first collapse to (key, value, count)
with a map-side hash aggregate.  A hot key then holds at most as many rows as it
has distinct values, and the exact percentile works on those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ..functions import Band, band, pct, ratio


def value_counts(
    df: DataFrame,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    flag: str | None = None,
) -> DataFrame:
    """Count rows by keys, measure and value; one scan serves all measures.

    Measures are whole numbers: counting a continuous one would not shrink it.
    With ``flag``, ``n_flag`` and ``n_flag_known`` count its true and non-null rows.
    """
    for name in measures:
        if not isinstance(df.schema[name].dataType, IntegralType):
            raise TypeError(f"{name} is not a whole number")
    kept = [*keys, *([flag] if flag else [])]
    long = df.select(*kept, *[F.col(m).cast("long").alias(m) for m in measures])
    if len(measures) == 1:
        long = long.select(
            *kept, F.lit(measures[0]).alias("measure"), F.col(measures[0]).alias("value")
        )
    else:
        long = long.unpivot(kept, list(measures), "measure", "value")
    counts = [F.count("*").alias("n")]
    if flag:
        counts.append(F.count_if(F.col(flag)).alias("n_flag"))
        counts.append(F.count(flag).alias("n_flag_known"))
    return long.groupBy(*keys, "measure", "value").agg(*counts)


def quantiles(value: Column, *fractions: float, weight: str = "n") -> Column:
    """Exact interpolated quantiles of counted values, as one array.

    NULL values do not count.  One aggregate serves all fractions.
    """
    return F.percentile(value, F.array(*[F.lit(f) for f in fractions]), F.col(weight))


def value_of(measure: str) -> Column:
    """The value on rows of one measure, NULL elsewhere."""
    return F.when(F.col("measure") == measure, F.col("value"))


def rows_of(measure: str, weight: str = "n") -> Column:
    return F.sum(F.when(F.col("measure") == measure, F.col(weight)))


def moments(value: Column | None = None, weight: str = "n") -> dict[str, Column]:
    """Exact sums: size, total and total of squares, as decimals that cannot overflow."""
    value = F.col("value") if value is None else value
    known = F.when(value.isNotNull(), F.col(weight))
    wide = value.cast("decimal(19,0)")
    return {
        "size": F.coalesce(F.sum(known), F.lit(0)),
        "total": F.sum(wide * F.col(weight)),
        "squares": F.sum((wide * wide * F.col(weight)).cast("decimal(38,0)")),
    }


def variance(size: Column, total: Column, squares: Column, sample: bool = False) -> Column:
    """Variance of whole numbers from exact sums: no cancellation, no order effects."""
    wide = size.cast("decimal(19,0)")
    spread = (wide * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    pairs = wide * (wide - 1) if sample else wide * wide
    return F.try_divide(spread.cast("double"), pairs.cast("double"))


def distribution(
    df: DataFrame, measures: Sequence[str], fractions: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Per keys and measure: n, mean, the named quantiles and the sample deviation."""
    summed = value_counts(df, measures, keys).groupBy(*keys, "measure").agg(
        *[c.alias(k) for k, c in moments().items()],
        quantiles(F.col("value"), *fractions.values()).alias("q"),
    )
    size, total, squares = F.col("size"), F.col("total"), F.col("squares")
    return summed.select(
        *keys,
        "measure",
        size.alias("n"),
        ratio(total, size).alias("mean"),
        *[F.col("q")[i].alias(name) for i, name in enumerate(fractions)],
        F.sqrt(variance(size, total, squares, sample=True)).alias("stddev"),
    )


def first_per_key(
    df: DataFrame, key: str, order: Sequence[Column | str], values: Sequence[str]
) -> DataFrame:
    """The values of each key's first row in ``order``, NULLs last.

    A minimum over structs: combined before the shuffle, so a key with very many
    rows sends one per task, and no window holds them.
    """
    ranked = []
    for i, c in enumerate(order):
        column = F.col(c) if isinstance(c, str) else c
        ranked += [column.isNull().alias(f"null_{i}"), column.alias(f"by_{i}")]
    first = F.min(F.struct(*ranked, *[F.col(v).alias(f"is_{v}") for v in values]))
    picked = [F.col(f"first.is_{v}").alias(v) for v in values]
    return df.groupBy(key).agg(first.alias("first")).select(key, *picked)


def share_of_total(df: DataFrame, measure: str, name: str) -> DataFrame:
    """Each row's part of the column total in percent; ``df`` is already grouped."""
    everything = Window.partitionBy()
    return df.withColumn(name, pct(F.col(measure), F.sum(measure).over(everything)))


def band_profile(
    df: DataFrame, value: str, bands: Sequence[Band], extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows per band, with further aggregates."""
    return df.groupBy(band(value, bands).alias("bucket")).agg(
        F.count("*").alias("n_orders"), *[c.alias(k) for k, c in (extra or {}).items()]
    )


def variance_explained(
    df: DataFrame,
    measure: str,
    keys: Mapping[str, str | Sequence[str]],
) -> DataFrame:
    """Share of a measure's variance left out by subtracting each group's median.

    ``keys`` maps a name to a grouping column or a set of them.  All sets are grouped by
    one expansion of the counted values, so the input is read once and no window holds
    rows.  A group needs its size, sums and median only: the squares about a median
    follow from those.  Sums are of doubled integers (a median of whole numbers is a
    multiple of one half) over the rows that belong to a group under every key.
    Returns one row: size, total variance, and per name the within variance.
    """
    sets = {name: [key] if isinstance(key, str) else list(key) for name, key in keys.items()}
    if not sets or not all(sets.values()):
        raise ValueError("every key needs a column")
    columns = list(dict.fromkeys(c for key in sets.values() for c in key))
    distinct = list(dict.fromkeys(tuple(sorted(key, key=columns.index)) for key in sets.values()))
    # Of a grouping id, the bits of the columns that a set leaves out.
    ids = {
        key: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in key)
        for key in distinct
    }
    counted = value_counts(df, [measure], columns)
    complete = F.lit(True)
    for c in columns:
        complete &= F.col(c).isNotNull()
    kept = F.when(complete & F.col("value").isNotNull(), F.col("n")).otherwise(0)
    counted = counted.withColumn("kept", kept)
    # Columns are grouped under other names, as a grouping set blanks them.
    marked = counted.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)], "value", "n", "kept")
    named = [f"_{i}" for i in range(len(columns))]
    grouped = marked.groupingSets([[f"_{columns.index(c)}" for c in key] for key in distinct], *named).agg(
        F.grouping_id().alias("set"),
        (2 * quantiles(F.col("value"), 0.5)[0]).cast("long").alias("centre"),
        *[c.alias(k) for k, c in moments(2 * F.col("value"), "kept").items()],
    )
    wide = F.col("centre").cast("decimal(19,0)")
    size = F.col("size").cast("decimal(19,0)")
    total, squares = F.coalesce("total", F.lit(0)), F.coalesce("squares", F.lit(0))
    about = {
        "size": F.col("size"),
        "total": total,
        "squares": squares,
        "rest": (total - size * wide).cast("decimal(38,0)"),
        "rest_squares": (squares - 2 * wide * total + size * wide * wide).cast("decimal(38,0)"),
    }
    rows = grouped.where(F.col("size") > 0).select("set", *[c.alias(k) for k, c in about.items()])
    sums = {}
    for key, number in ids.items():
        for part in about:
            sums[f"{number}_{part}"] = F.sum(F.when(F.col("set") == number, F.col(part)))
    exact = rows.agg(*[c.alias(k) for k, c in sums.items()])
    first = ids[distinct[0]]
    n = F.coalesce(F.col(f"{first}_size"), F.lit(0))

    def spread(prefix: str) -> Column:
        parts = [F.col(f"{first}_size"), *[F.col(f"{prefix}{part}") for part in ("", "_squares")]]
        return variance(*parts) / 4

    whole = variance(*[F.col(f"{first}_{part}") for part in ("size", "total", "squares")]) / 4
    return exact.select(
        n.alias("n_orders"),
        whole.alias("total_variance"),
        *[
            spread(f"{ids[tuple(sorted(key, key=columns.index))]}_rest").alias(f"within_{name}")
            for name, key in sets.items()
        ],
    )
