"""Comparing rows that share a key, in blocks of bounded size.

A key that few rows share is one block.  A hot key's rows are dealt by hash into
blocks, and every pair of blocks is a group of its own, so no task ever holds
more than two blocks and no row is dropped.  Comparison results leave a group
as counts or as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import freeze

BLOCK_ROWS = 2048


def shared_keys(keyed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``keyed`` (key, ...) without keys of one row; adds ``n_blocks`` of the key.

    Counting combines on the map side.  The join is a sort-merge join at every size:
    its cost follows the input, and a hot key's partition is split at run time.
    """
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counts = counts.select(
        "key", F.ceil(F.col("n") / F.lit(float(block_rows))).cast("int").alias("n_blocks")
    )
    return keyed.join(freeze(counts, "shared-keys").hint("merge"), "key")


def paired_blocks(keyed: DataFrame, item: str) -> DataFrame:
    """Rows of ``shared_keys`` dealt to pairs of blocks (block_a <= block_b), sorted by group.

    ``side`` is the row's own block; two rows of one block meet only where
    both blocks are the same.
    """
    side = F.pmod(F.xxhash64(F.col(item), F.lit(7)), F.col("n_blocks")).cast("int")
    dealt = (
        keyed.withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("block_a", F.least("side", "other"))
        .withColumn("block_b", F.greatest("side", "other"))
        .drop("other", "n_blocks")
    )
    group = ["key", "block_a", "block_b"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "side", item)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup sorted batches so that no (key, block_a, block_b) is cut; with group starts."""
    held: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        columns = [t[c].to_numpy() for c in ("key", "block_a", "block_b")]
        change = np.zeros(t.num_rows, dtype=bool)
        change[:1] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        starts = bounds(t)
        cut = int(starts[-1])
        if cut:
            yield t.slice(0, cut), starts[:-1]
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)


def close_pairs(
    starts: np.ndarray,
    sides: np.ndarray,
    blocks: tuple[np.ndarray, np.ndarray],
    close: Callable[[np.ndarray, np.ndarray], np.ndarray],
    most: int = 1 << 20,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, j) of one group that ``close`` accepts, in portions of bounded size.

    Groups of different blocks compare only rows from different sides.
    """
    n = len(sides)
    sizes = np.diff(np.append(starts, n))
    ends = np.repeat(starts + sizes, sizes)
    crossing = blocks[0] != blocks[1]
    rows = np.flatnonzero(ends - np.arange(n) > 1)
    step = 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    while len(rows):
        for part in range(0, len(rows), most):
            i = rows[part : part + most]
            j = i + step
            keep = ~crossing[i] | (sides[i] != sides[j])
            i, j = i[keep], j[keep]
            hit = close(i, j)
            found.append((i[hit], j[hit]))
            total += int(hit.sum())
            if total >= most:
                yield tuple(np.concatenate(c) for c in zip(*found))
                found, total = [], 0
        step += 1
        rows = rows[ends[rows] - rows > step]
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found))


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge links (i, j) into ``labels``, each the least row of its component so far."""
    while len(i):
        a, b = labels[i], labels[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return labels
        i, j = i[open_], j[open_]
        np.minimum.at(labels, high[open_], low[open_])
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels
