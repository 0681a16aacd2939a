"""Sharding by balanced label propagation.

Every document starts in a shard by its hash rank, so counts differ by one at most.
In each round a group (the documents that are each other's neighbours) looks at the
shards its members are in.  If the whole group fits one of them, counting the documents there that
nothing holds, all members want to go to the fullest of those; if it fits none of them but the
shard with the most room, to that one.  A group that fits nowhere keeps its fullest shards, as many
as hold it, and the members in its other shards want to go to the open ones of these, as many to
each as it has room.  Moves are exchanges: a place opens in a shard only as a document
without neighbours there leaves it for the place that the mover gives up.  So every round keeps
every shard's count, and the quota of a shard is its number of documents that nothing holds there.

Rounds go on until no group has a move left.  They end: a move goes to a shard with as many or
more of the group than the one it leaves, or makes the group whole (then all members move or
none), so each raises the sum over groups and shards of squared counts.

Ranks and numbers within a shard are made in hashed slices: rows are numbered in their
slice, and slices get offsets from a small table of counts, so no shard is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import freeze

SHARDS = 40
SLICE_ROWS = 50_000  # numbered by one task at most, on average
COUNTED_SLICES = 64  # so many slices are counted in one row per group
FEW_OFFSETS = 500_000  # go to all executors
OVERHEAD = 16  # fixed value: bytes beside the text


def numbered(
    rows: DataFrame, groups: list[str], order: Column, slices: int, name: str, few: bool = False
) -> DataFrame:
    """``rows`` with ``name``, a number from 0 without gaps within ``groups``, in hash order.

    ``order`` is a hash (long) that spreads evenly over its range.  ``few`` says that groups
    and slices are few: then the offsets, one for each of both, go to all executors.
    """
    width = ((1 << 63) - 1) // slices + (slices > 1)
    at = rows.withColumn("_order", F.shiftrightunsigned(order, 1))
    at = at.withColumn("_slice", F.expr(f"int(_order div {width})"))
    offsets = _offsets(at, groups, slices)
    inside = Window.partitionBy(*groups, "_slice").orderBy("_order", "row")
    ranked = at.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(F.broadcast(offsets) if few else offsets, [*groups, "_slice"])
        .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("long"))
        .drop("_order", "_slice", "_rank", "_offset")
    )


def _offsets(at: DataFrame, groups: list[str], slices: int) -> DataFrame:
    """(groups, _slice, _offset): the group's rows in earlier slices."""
    if slices <= COUNTED_SLICES:  # a group's slices in one row: a shuffle less
        counts = [F.count_if(F.col("_slice") == k) for k in range(slices)]
        sizes = at.groupBy(*groups).agg(F.array(*counts).alias("_n"))
        zero = F.lit(0).cast("long")
        before = F.transform(
            F.sequence(F.lit(0), F.lit(slices - 1)),
            lambda k: F.aggregate(F.slice("_n", F.lit(1), k), zero, lambda done, n: done + n),
        )
        return sizes.select(*groups, F.posexplode(before).alias("_slice", "_offset"))
    sizes = at.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def slices_for(rows: DataFrame, total: int, groups: int = 1) -> int:
    """Slices per group: small enough, and at least two for each shuffle partition."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-max(-(-total // SLICE_ROWS), 2 * partitions) // groups))


def _mixed(*parts: Column) -> Column:
    return F.xxhash64(F.lit(29), *parts)


def label_propagation(nodes: DataFrame, shards: int) -> DataFrame:
    """(row, shard) for nodes (row, group); counts of shards differ by one at most.

    Members of a group are each other's neighbours; a null group has none.  ``row`` is
    unique.
    """
    total = nodes.count()
    slices = slices_for(nodes, total, shards)
    sizes = nodes.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("members"))
    linked = freeze(sizes.where("members > 1"), "groups")
    # Only documents with neighbours keep their group; the others are free to give way.
    known = nodes.join(linked.select("group", F.lit(True).alias("held")), "group", "left")
    known = known.select("row", F.when(F.col("held"), F.col("group")).alias("group"))
    start = known.withColumn("_all", F.lit(0))
    start = numbered(start, ["_all"], _mixed(F.col("row")), slices_for(nodes, total), "rank")
    state = start.select("row", "group", (F.col("rank") % shards).cast("int").alias("shard"))
    state = freeze(state, "shards")
    most = max(1, total // (shards * slices))
    number = 0
    while (moved := _round(state, shards, slices, number, most)) is not None:
        state, number = freeze(moved, "shards"), number + 1
    return state.select("row", "shard")


def _plan(counts: DataFrame, room: list[int]) -> DataFrame:
    """(group, shard) to leave, with the targets' shares of the movers.

    ``targets`` holds (first seat, shard); the members in ``shard`` take the seats from
    ``begin``.  ``together`` groups move as a whole or not at all.
    """
    widest = max(range(len(room)), key=room.__getitem__)
    own = Window.partitionBy("group")
    at = (
        counts.withColumn("free", F.array(*map(F.lit, room))[F.col("shard")])
        .withColumn("members", F.sum("n").over(own))
        .withColumn("fullest", F.max("n").over(own))
        .where(F.col("n") < F.col("members"))
        .withColumn("fits", F.expr("free > 0 AND n + free >= members"))
    )
    best = own.orderBy(
        F.desc("fits"), F.desc("n"), F.expr("free > 0").desc(), _mixed(F.col("group"), F.col("shard")), "shard"
    )
    first = F.first(F.struct("fits", "shard", "n")).over(best)
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    all_ = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (
        at.withColumn("top", first)
        .withColumn(
            "home",
            F.when(F.col("top.fits"), F.col("top.shard")).when(
                F.lit(room[widest]) >= F.col("members"), F.lit(widest)
            ),
        )
        .withColumn("held", F.coalesce(F.sum(F.expr("n + free")).over(before), F.lit(0)))
        .withColumn("kept", F.expr("CASE WHEN home IS NULL THEN held < members ELSE shard = home END"))
        .withColumn("seat", F.coalesce(F.sum(F.expr("int(kept) * free")).over(before), F.lit(0)))
        .withColumn("begin", F.coalesce(F.sum(F.expr("int(NOT kept) * n")).over(before), F.lit(0)))
    )
    share = F.struct(F.col("seat").alias("seat"), F.col("shard").alias("shard"))
    at = at.withColumn("open", F.collect_list(F.when(F.expr("kept AND free > 0"), share)).over(all_))
    # Only a fuller shard's members must not be split by a move; see above.
    together = F.expr("home IS NOT NULL AND NOT (top.fits AND top.n >= fullest)")
    alone = F.array(F.struct(F.lit(0).cast("long").alias("seat"), F.col("home").alias("shard")))
    return at.where("NOT kept").select(
        "group",
        "shard",
        "begin",
        "members",
        F.when(F.col("home").isNull(), F.col("open")).otherwise(alone).alias("targets"),
        together.alias("together"),
    )


def _round(
    state: DataFrame, shards: int, slices: int, number: int, most: int = SLICE_ROWS
) -> DataFrame | None:
    """The next state, or none if no document gains by a move that has room.

    Groups of more than ``most`` members move by their rows' hashes, where they may be parted.
    """
    open_ = state.where("group IS NULL")
    room = list(open_.agg(*[F.count_if(F.col("shard") == k) for k in range(shards)]).first())
    counts = state.where("group IS NOT NULL").groupBy("group", "shard").agg(F.count("*").alias("n"))
    plan = freeze(_plan(counts, room), "plan")
    plans, parting = plan.agg(F.count("*"), F.count_if(F.size("targets") > 1)).first()
    if not plans:
        return None
    few = shards * slices <= FEW_OFFSETS
    movers = state.join(plan, ["group", "shard"])
    if not parting:
        movers = movers.withColumn("target", F.col("targets")[0]["shard"])
    else:
        one = movers.where("size(targets) = 1").withColumn("target", F.col("targets")[0]["shard"])
        many = movers.where("size(targets) > 1")
        by_row = _mixed(F.col("row"), F.lit(number))
        many = numbered(many, ["group", "shard"], by_row, slices, "inner", parting * slices <= FEW_OFFSETS)
        last = F.expr("element_at(filter(targets, t -> t.seat <= begin + inner), -1).shard")
        movers = one.unionByName(many.withColumn("target", last).drop("inner"))
    # Members of a group get turns in a row, unless they may be parted and are too many for a slice.
    parted = F.expr(f"NOT together AND members > {most}")
    turn = F.when(parted, _mixed(F.col("row"), F.lit(number)))
    turn = turn.otherwise(_mixed(F.col("group"), F.lit(number)))
    movers = movers.select("row", "group", "shard", "target", "together", turn.alias("by"))
    movers = numbered(movers, ["target"], F.col("by"), slices, "turn", few)
    # A shard that takes and gives at once keeps its count as each move is an exchange.
    movers = movers.withColumn("free", F.array(*map(F.lit, room))[F.col("target")])
    movers = freeze(movers.drop("by").where("turn <= free"), "movers")
    # At most one group per target reaches over its room.
    cut = movers.where("together AND turn = free").select("group", "target")
    movers = movers.where("turn < free").join(F.broadcast(cut), ["group", "target"], "left_anti")
    free = open_.select("row", F.col("shard").alias("target"))
    free = numbered(free, ["target"], _mixed(F.col("row"), F.lit(number)), slices, "turn", few)
    places = movers.select("target", "turn", F.col("shard").alias("to"))
    free = free.join(places, ["target", "turn"], "left")
    no_group = F.lit(None).cast(state.schema["group"].dataType).alias("group")
    free = free.select("row", no_group, F.coalesce("to", "target").alias("shard"))
    held = state.where("group IS NOT NULL").join(movers.select("row", "target"), "row", "left")
    return free.unionByName(held.select("row", "group", F.coalesce("target", "shard").alias("shard")))


def shard_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shards: int = SHARDS,
) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``rows``: counts of shards differ by one at most.  Documents of equal
    text are neighbours; groups that fit are kept in one shard as far as the law
    leaves room.  ``slot`` numbers a shard's documents from 0.  A null text has 16 bytes and
    the checksum of no bytes, and null texts are a group; so are empty ones.  Null and
    repeated ids are placed row by row.  No rows give none.
    """
    text = F.col(text_column).cast("string")
    bytes_ = F.coalesce(text.cast("binary"), F.lit(b""))
    own = freeze(
        docs.select(
            F.col(id_column).alias("id"),
            (F.length(bytes_) + OVERHEAD).cast("long").alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("group"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "documents",
    )
    slices = slices_for(own, own.count(), shards)
    placed = label_propagation(own.select("row", "group"), shards)
    whole = own.drop("group").join(placed, "row")
    few = shards * slices <= FEW_OFFSETS
    whole = numbered(whole, ["shard"], _mixed(F.col("row"), F.lit("slot")), slices, "slot", few)
    return whole.select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
