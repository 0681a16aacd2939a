"""Exact quantiles of continuous measures by distributed selection.

Counting values shrinks whole days and hours; amounts of money or seconds are nearly all
different.  Here no group's values ever meet in one place.  A first pass keeps a small
mergeable summary per group, from which every wanted rank gets a bracket: two values
between which it lies for sure or nearly so.  A second pass counts what lies below each
bracket and keeps the few values inside, as counts.  Ranks are then read off those.  A
bracket that misses its rank, which the counts show, is replaced by the whole group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType
from pyspark.sql.window import Window

from ..session import freeze

# A summary's rank error is the group's size over its accuracy; a bracket is as wide as
# this many errors on either side.
LEAST_ACCURACY, MOST_ACCURACY = 10_000, 1_000_000
MARGIN = 2.0


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_of_{k}"]) for k in keys])


def _named(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def accuracy_for(rows: int) -> int:
    """A summary holds about as many entries as this, and a bracket rows / this."""
    return min(MOST_ACCURACY, max(LEAST_ACCURACY, math.isqrt(max(0, rows))))


def _brackets(rows: DataFrame, keys: Sequence[str], fractions: Sequence[float], accuracy: int) -> DataFrame:
    """Per group its size and, per fraction, (i, low, high, rank, next, part)."""
    margin = MARGIN / accuracy
    ends = [min(1.0, max(0.0, f + side * margin)) for f in fractions for side in (-1, 1)]
    summary = F.percentile_approx("_value", F.array(*map(F.lit, ends)), F.lit(accuracy))
    size = F.col("n")

    def bracket(i: int, f: float) -> Column:
        at = F.lit(f) * (size - 1)
        rank = F.floor(at)
        return F.struct(
            F.lit(i).alias("i"),
            F.col("_marks")[2 * i].alias("low"),
            F.col("_marks")[2 * i + 1].alias("high"),
            rank.alias("rank"),
            F.least(rank + 1, size - 1).alias("next"),
            (at - rank).alias("part"),
        )

    wanted = F.array(*[bracket(i, f) for i, f in enumerate(fractions)])
    mean = F.avg("_value")
    if "_whole" in rows.columns:  # exact sums don't depend on the order of addition
        mean = F.sum("_whole").cast("double") / F.count("*")
    grouped = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), mean.alias("mean"), summary.alias("_marks")
    )
    return grouped.select(*keys, "n", "mean", wanted.alias("_wanted"))


def _read_off(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, i, low_value, high_value, part); values are NULL where a bracket misses its rank.

    NULL ends of a bracket are open.
    """
    own = _named(brackets, keys)
    near = F.filter(
        "_wanted", lambda w: w["high"].isNull() | (F.col("_value") <= w["high"])
    )
    placed = rows.join(own, _same(rows, own, keys), "inner").select(
        *[rows[k] for k in keys], "_value", F.explode(near).alias("_w")
    )
    inside = F.when(F.col("_w.low").isNull() | (F.col("_value") >= F.col("_w.low")), F.col("_value"))
    # What lies below a bracket is one row per task, the values inside are few.
    counted = placed.groupBy(*keys, F.col("_w.i").alias("i"), inside.alias("_value")).agg(
        F.count("*").alias("c"), F.first("_w.rank").alias("rank"), F.first("_w.next").alias("next"),
        F.first("_w.part").alias("part"),
    )
    counted = freeze(counted, f"selection-{name}")
    up_to = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("_value"))
    running = counted.withColumn("_up_to", F.sum("c").over(up_to))
    below = F.coalesce(F.max(F.when(F.col("_value").isNull(), F.col("c"))), F.lit(0))

    def value_at(rank: str) -> Column:
        reached = F.min(F.when(F.col("_value").isNotNull() & (F.col("_up_to") > F.col(rank)), F.col("_value")))
        return F.when(below <= F.min(rank), reached)

    return running.groupBy(*keys, "i").agg(
        value_at("rank").alias("low_value"), value_at("next").alias("high_value"), F.first("part").alias("part")
    )


def exact_quantiles(
    df: DataFrame,
    measure: str,
    fractions: Mapping[str, float],
    keys: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Per group: ``n``, ``mean`` and the named interpolated quantiles of a numeric column.

    Quantiles are those of ``QUANTILE_CONT``: position ``f * (n - 1)``, interpolated between
    its neighbours, in double precision; the mean of decimals and whole numbers comes from
    an exact sum.  NULL values do not count; groups without other
    values are left out.  NULL keys are a group.  NaN is the largest value.  The input
    is read twice, and what moves is a summary per group and task and the values in the
    brackets, about ``2 * MARGIN / accuracy`` of a group per fraction.
    """
    if not fractions or not all(0 <= f <= 1 for f in fractions.values()):
        raise ValueError(f"fractions must be within [0, 1]: {dict(fractions)}")
    names, marks = list(fractions), list(fractions.values())
    groups = [f"_key_{i}" for i in range(max(1, len(keys)))]
    own = [F.col(f"`{k}`") for k in keys] or [F.lit(0)]
    value = F.col(f"`{measure}`").cast("double")
    kind = df.select(F.col(f"`{measure}`")).schema[0].dataType
    whole = [F.col(f"`{measure}`").alias("_whole")] if isinstance(kind, (DecimalType, IntegralType)) else []
    rows = df.select(*[c.alias(g) for c, g in zip(own, groups)], value.alias("_value"), *whole)
    rows = rows.where(F.col("_value").isNotNull())
    if accuracy is None:
        accuracy = accuracy_for(rows.count())
    brackets = freeze(_brackets(rows, groups, marks, accuracy), "brackets")
    found = freeze(_read_off(rows, brackets, groups, "first"), "selected")
    missed = found.where("low_value IS NULL OR high_value IS NULL")
    if missed.limit(1).count():
        lost = _named(missed.select(*groups, "i"), groups).withColumnRenamed("i", "_i")
        again = brackets.join(lost, _same(brackets, lost, groups), "inner").select(
            *[brackets[g] for g in groups], F.col("_wanted")[F.col("_i")].alias("w")
        )
        end = brackets.schema["_wanted"].dataType.elementType["low"].dataType
        whole = F.col("w").withField("low", F.lit(None).cast(end)).withField("high", F.lit(None).cast(end))
        again = again.groupBy(*groups).agg(F.collect_list(whole).alias("_wanted"))
        found = found.where("low_value IS NOT NULL AND high_value IS NOT NULL").union(
            _read_off(rows, again, groups, "again")
        )
    at = F.col("low_value") + (F.col("high_value") - F.col("low_value")) * F.col("part")
    exact = F.when(F.col("low_value") == F.col("high_value"), F.col("low_value")).otherwise(at)
    wide = found.groupBy(*groups).agg(
        *[F.max(F.when(F.col("i") == i, exact)).alias(f"_q{i}") for i in range(len(names))]
    )
    sizes = _named(brackets.select(*groups, "n", "mean"), groups)
    return wide.join(sizes, _same(wide, sizes, groups), "inner").select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys)],
        "n", "mean", *[F.col(f"_q{i}").alias(name) for i, name in enumerate(names)],
    )
