"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source whose target is ``r`` times its size wants ``r`` copies of each document:
``floor(r)`` for sure and one more with probability ``r - floor(r)``.  Independent
draws would miss the target by the square root of the source; dependent rounding
misses it by one document.  Two documents with fractional probabilities trade
mass, words for words, so that the expected words of the pair stay and one of the
two becomes 0 or 1; which way is drawn with the odds that keep both expectations.

The trades form a tree.  Leaves are hashed groups of some hundred documents of a
source (a hot source simply has more of them), each folded to at most one document
whose probability is still fractional; those meet in groups again, until one is
left per source and is drawn on its own.  Decided documents leave the tree at the
level where they became integral.  No group grows with the data, and every draw is
a hash of ids, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import freeze

# What separates words, the repeating weights, the most copies.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3.0

FAN = 512  # fractional documents that meet in a group of the tree, on average


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target, rows) for rows (source, size, m), ``size`` of ``m`` documents.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of
    all sizes.  A target stops at ``most`` times its source's size; the excess is
    shared by weight among the others until none is above.  In the order of
    ``most * size / weight`` the stopped sources come first: one is stopped if the
    level that the words still to share would reach without it exceeds its own.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum("m").alias("rows")
    )
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    capped = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = capped.withColumn("level", left / open_weight).withColumn(
        "stopped", F.col("level") * F.col("weight") > F.col("cap")
    )
    final = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "level")))
    level = final.over(every)["level"]
    return ranked.select(
        "source",
        "source_size",
        "rows",
        F.when(F.col("stopped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"),
    )


# A document in the tree.  Structs sort by their first field: a group is folded from the
# longest text (``less`` is minus its size) to the shortest, so that what stays open at
# the end, and with it the error of the source, is a short text.
_DOC = T.StructType(
    [
        T.StructField("less", T.LongType()),
        T.StructField("order", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("nth", T.LongType()),
        T.StructField("p", T.DoubleType()),
    ]
)
_STATE = T.StructType([T.StructField("open", _DOC), T.StructField("done", T.ArrayType(_DOC))])
SNAP = 1e-9  # a probability this near 0 or 1 is integral


def _with(doc: Column, p: Column) -> Column:
    snapped = F.when(p < SNAP, 0.0).when(p > 1 - SNAP, 1.0).otherwise(p)
    return F.struct(
        doc["less"].alias("less"),
        doc["order"].alias("order"),
        doc["id"].alias("id"),
        doc["size"].alias("size"),
        doc["nth"].alias("nth"),
        snapped.alias("p"),
    ).cast(_DOC)


def _uniform(seed: int, *parts: Column) -> Column:
    """A draw in [0, 1) that depends on the ids only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _trade(state: Column, doc: Column, seed: int) -> Column:
    """Fold one more document in: it trades with the open one, and one of them is decided."""
    held = state["open"]
    a, b = held["size"].cast("double"), doc["size"].cast("double")
    x, y = held["p"], doc["p"]
    up = F.least(1 - x, y * b / a)  # held gains up, doc loses up * a / b
    down = F.least(x, (1 - y) * b / a)  # held loses down, doc gains down * a / b
    gains = _uniform(seed, held["order"], held["nth"], doc["order"], doc["nth"]) < (
        down / (up + down)
    )
    moved = F.when(gains, up).otherwise(-down)
    first = _with(held, x + moved)
    second = _with(doc, y - moved * a / b)

    def split(one: Column, other: Column) -> Column:
        """Of two traded documents, which is open and which are done."""
        integral = lambda d: d["p"].isin(0.0, 1.0)
        none = F.lit(None).cast(_DOC)
        return (
            F.when(
                integral(one) & integral(other),
                F.struct(
                    none.alias("open"), F.concat(state["done"], F.array(one, other)).alias("done")
                ),
            )
            .when(
                integral(one),
                F.struct(other.alias("open"), F.concat(state["done"], F.array(one)).alias("done")),
            )
            .otherwise(
                F.struct(one.alias("open"), F.concat(state["done"], F.array(other)).alias("done"))
            )
            .cast(_STATE)
        )

    fresh = F.struct(doc.alias("open"), state["done"].alias("done")).cast(_STATE)
    return F.when(held.isNull(), fresh).otherwise(split(first, second))


def _fold(docs: DataFrame, seed: int) -> DataFrame:
    """One level: every (source, bucket) becomes one state."""
    start = F.struct(
        F.lit(None).cast(_DOC).alias("open"), F.array().cast(T.ArrayType(_DOC)).alias("done")
    ).cast(_STATE)
    groups = docs.groupBy("source", "bucket").agg(
        F.sort_array(F.collect_list("doc")).alias("docs")
    )
    folded = F.aggregate("docs", start, lambda state, doc: _trade(state, doc, seed))
    return groups.select("source", "bucket", folded.alias("s"))


def pivotal_rounding(docs: DataFrame, most_rows: int, seed: int, fan: int = FAN) -> DataFrame:
    """(source, id, size, nth, extra 0 or 1) for rows (source, id, size, nth, p, rows).

    ``p`` lies strictly between 0 and 1 and sizes above 0; within a source the sum of
    ``size * extra`` differs from that of ``size * p`` by less than one document.
    ``rows`` counts the source's rows, ``most_rows`` those of the largest.
    """
    order = F.xxhash64(F.lit(seed), "id", "size", "nth")
    doc = F.struct(-F.col("size"), order.alias("order"), "id", "size", "nth", "p").cast(_DOC)
    buckets = F.ceil(F.col("rows") / F.lit(float(fan)))
    level = docs.select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed + 1), "id", "size", "nth"), buckets).alias("bucket"),
        doc.alias("doc"),
    )
    decided = []
    levels = 1 + max(1, math.ceil(math.log(max(2, most_rows), fan)))
    for k in range(levels):
        folded = freeze(_fold(level, seed + 2 + k), f"rounding-{k}")
        decided.append(folded.select("source", F.explode("s.done").alias("doc")))
        level = folded.where("s.open IS NOT NULL").select(
            "source", F.floor(F.col("bucket") / fan).alias("bucket"), F.col("s.open").alias("doc")
        )
    drawn = F.when(_uniform(seed, F.col("doc.order"), F.col("doc.nth")) < F.col("doc.p"), 1.0)
    last = level.withColumn("doc", _with(F.col("doc"), drawn.otherwise(0.0)))
    every = last.select("source", "doc")
    for part in decided:
        every = every.unionByName(part)
    return every.select(
        "source", "doc.id", "doc.size", "doc.nth", F.col("doc.p").cast("int").alias("extra")
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: float = MOST_COPIES,
    seed: int = 20,
) -> DataFrame:
    """One row per document: id, ``size`` (words), ``source_size``, ``target``, ``taken``, ``copies``.

    Also ``source`` and ``nth``, which tells rows of equal id, size and source apart.
    ``copies`` is floor or ceil of target / source_size, so at most ``most``; the sum
    of ``taken`` (size times copies) in a source is within one document of its
    target.  A null text, or one without words, has size 0 and no copies; so have all
    rows of a source without words, whose target is 0.  A null source is a source of
    its own.  Null and repeated ids are mixed row by row.  No rows give none.
    """
    kind = docs.schema[id_column].dataType
    own = docs.select(
        F.col(id_column).cast("string").alias("id"),
        F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column)).alias("size"),
    )
    counted = freeze(own.groupBy("source", "id", "size").agg(F.count("*").alias("m")), "sizes")
    sizes = counted.select("source", (F.col("size") * F.col("m")).alias("size"), "m")
    targets = freeze(source_targets(sizes, weights, most), "targets")
    most_rows = counted.groupBy("source").agg(F.sum("m").alias("n")).agg(F.max("n")).first()[0]
    rows = (
        counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn(
            "rate",
            F.when(F.col("size") == 0, 0.0).otherwise(
                F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
            ),
        )
        .withColumn("sure", F.floor(F.col("rate") + SNAP).cast("int"))
        .withColumn("p", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))
        .withColumn("rows", F.col("rows").cast("double"))
    )
    open_ = F.col("p") > SNAP
    rounded = pivotal_rounding(rows.where(open_), most_rows or 0, seed)
    whole = rows.where(~open_).select("source", "id", "size", "nth", F.lit(0).alias("extra"))
    named = targets.select(F.col("source").alias("s"), "source_size", "target")
    copies = F.when(F.col("size") == 0, 0).otherwise(
        F.floor(F.col("target") / F.col("source_size") + SNAP).cast("int") + F.col("extra")
    )
    return (
        rounded.unionByName(whole)
        .join(named, F.col("source").eqNullSafe(F.col("s")))
        .select(
            F.col("id").cast(kind).alias(id_column),
            "size",
            "source_size",
            "target",
            (F.col("size") * copies).alias("taken"),
            copies.alias("copies"),
            "source",
            "nth",
        )
    )
