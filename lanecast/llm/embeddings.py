"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A vector is normalised, turned three times (random signs, then the fast Hadamard
transform), and hashed to the nearest of the 2d corners of the cross-polytope: the
axis, with sign, of its largest coordinate.  A table's key joins several such hashes; multiprobe adds
the keys with the next best corners, by how little they lose.  Two vectors
meet if they share a key of a table.  The number of tables follows from the recall
wanted at the threshold, measured by simulating pairs exactly at the threshold.

Only vectors with equal labels can meet, as the label is part of the key.  Equal
vectors enter the search once.  Candidates are verified by cosine in double precision,
in bounded blocks, so a hot key is no single task; links are counted where they are
first found, and leave a block as counts and a spanning forest, not as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import close_pairs, forest, paired_blocks, shared_keys, whole_groups
from .components import connected_components
from .tables import dealt_evenly, freeze, importable

THRESHOLD = 0.98  # fixed value of the contract
RECALL = 0.999
PROBES = 4  # keys per table
MOST_TABLES = 128  # beyond these, fewer hashes make larger buckets
LAST_TABLES = 1024  # of a single hash
BUCKET_ROWS = 64  # wanted at most in a bucket of spread-out vectors
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows, whose length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / math.sqrt(d)


@cache
def _signs(d: int, number: int) -> np.ndarray:
    return np.random.default_rng((SEED, d, number)).choice([-1.0, 1.0], size=(3, d))


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """The ``number``-th pseudo-random rotation, padded to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for signs in _signs(d, number):
        y = hadamard(y * signs)
    return y


@dataclass(frozen=True)
class Plan:
    """Hashes joined in a key, keys probed in a table, and tables."""

    hashes: int
    probes: int
    tables: int
    threshold: float


def keys(x: np.ndarray, plan: Plan) -> np.ndarray:
    """[vector, table, probe] key numbers of unit vectors, ascending within a table."""
    n = len(x)
    out = np.empty((n, plan.tables, plan.probes), dtype=np.int64)
    top = min(plan.probes, x.shape[1])
    for t in range(plan.tables):
        # Best combinations so far: key number and what it loses.
        number = np.zeros((n, 1), dtype=np.int64)
        loss = np.zeros((n, 1))
        for h in range(plan.hashes):
            y = rotate(x, t * plan.hashes + h)
            size = np.abs(y)
            # Ties between coordinates go to the lower axis.
            axis = np.argsort(-size, axis=1, kind="stable")[:, :top]
            corner = axis * 2 + (np.take_along_axis(y, axis, 1) < 0)
            lost = size.max(axis=1, keepdims=True) - np.take_along_axis(size, axis, 1)
            number = (number[:, :, None] * (2 * y.shape[1]) + corner[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, : plan.probes]
            number = np.take_along_axis(number, best, 1)
            loss = np.take_along_axis(loss, best, 1)
        # One-dimensional vectors have fewer corners than probes.
        short = plan.probes - number.shape[1]
        number = np.concatenate([number, np.repeat(number[:, -1:], short, axis=1)], axis=1)
        out[:, t] = np.sort(number, axis=1)
    return out


def plan_for(d: int, rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    """Enough hashes for small buckets among ``rows``, enough tables for the recall.

    The recall is measured on pairs at the threshold.  If ``MOST_TABLES`` miss it, hashes
    are dropped one by one: larger buckets, more comparisons, no lost pairs.  With a single
    hash tables grow until the recall is met; a threshold that random vectors reach, where
    buckets no longer help, is an error and not a silent loss.
    """
    corners = 2 * (1 << max(0, d - 1).bit_length())
    wanted = math.log(max(2.0, rows * PROBES / BUCKET_ROWS)) / math.log(corners)
    hashes = max(1, min(math.ceil(wanted), int(60 / math.log2(corners))))
    if d < 2:
        return Plan(1, 1, 1, threshold)
    rng = np.random.default_rng(SEED)
    x = rng.standard_normal((1000, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((1000, d))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * away
    tables = 4
    while tables <= LAST_TABLES:
        plan = Plan(hashes, PROBES, tables, threshold)
        a, b = keys(x, plan), keys(y, plan)
        meet = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))
        miss = 1 - meet.mean()
        if miss < 1:
            needed = 1 if miss == 0 else math.ceil(math.log(1 - recall) / math.log(miss))
            if needed <= tables:
                return Plan(hashes, PROBES, max(1, needed), threshold)
        tables *= 2
        if tables > MOST_TABLES and hashes > 1:
            hashes, tables = hashes - 1, 4
    raise ValueError(f"{LAST_TABLES} tables miss the recall {recall} at the threshold {threshold}")


def _unit(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(values), -1)
    # Scaling first keeps squares of huge or tiny components in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_width(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == d)))


def _emit_keys(plans: dict[int, Plan]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_width(whole, "v"):
                x = _unit(batch.column("v"))
                plan = plans[x.shape[1]]
                found = keys(x, plan)
                n = len(x)
                flat = pa.array(found.reshape(n, -1).tolist(), pa.list_(pa.int64()))
                for t in range(plan.tables):
                    for p in range(plan.probes):
                        own = found[:, t, p]
                        fresh = np.ones(n, bool) if p == 0 else own != found[:, t, p - 1]
                        at = pa.array(np.flatnonzero(fresh))
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("vec").take(at),
                                batch.column("label").take(at),
                                pa.array(np.full(len(at), t * plan.probes, np.int32)),
                                pa.array(own[fresh]),
                                batch.column("v").take(at),
                                flat.take(at),
                                batch.column("copies").take(at),
                            ],
                            ["vec", "label", "place", "code", "v", "keys", "copies"],
                        )

    return run


def _compare(threshold: float, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches):
            n = len(rows)
            vec = rows["vec"].to_numpy()
            blocks = rows["block_a"].to_numpy(), rows["block_b"].to_numpy()
            place = rows["place"].to_numpy()
            code = rows["code"].to_numpy()
            widths = np.diff(rows["v"].combine_chunks().offsets.to_numpy())
            unit = np.zeros((n, int(widths.max())))
            known = np.full((n, int(max(map(len, rows["keys"].to_pylist())))), -1, np.int64)
            for d in np.unique(widths):
                own = np.flatnonzero(widths == d)
                unit[own, :d] = _unit(rows["v"].take(pa.array(own)))
                all_keys = rows["keys"].take(pa.array(own)).combine_chunks()
                flat = all_keys.flatten().to_numpy().reshape(len(own), -1)
                known[own, : flat.shape[1]] = flat
            # Two labels can share a key by chance, as it is a hash.
            label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            labels = np.arange(n)
            linked = np.zeros(n, dtype=np.int64)
            copies = rows["copies"].to_numpy()

            def close(i, j):
                alike = (label[i] == label[j]) & (widths[i] == widths[j])
                return alike & (np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold)

            for i, j in close_pairs(starts, rows["side"].to_numpy(), blocks, close, 1 << 16):
                # Count a pair only in the first key that both have.
                first = np.ones(len(i), dtype=bool)
                for t in range(0, known.shape[1], probes):
                    a, b = known[i, t : t + probes], known[j, t : t + probes]
                    for p in range(probes):
                        met = (a[:, p : p + 1] == b).any(axis=1)
                        earlier = (t < place[i]) | ((t == place[i]) & (a[:, p] < code[i]))
                        first &= ~(met & earlier)
                labels = forest(labels, i, j)
                np.add.at(linked, i[first], copies[j[first]])
                np.add.at(linked, j[first], copies[i[first]])
            some = np.flatnonzero((labels != np.arange(n)) | (linked > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(vec[some]), pa.array(vec[labels[some]]), pa.array(linked[some])],
                ["a", "b", "n"],
            )

    return run


def near_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their labels are equal and not null, their lengths are equal, and
    their cosine is at least ``threshold`` (never below it); ``recall`` of the pairs at
    the threshold are found, of closer ones more, of equal vectors all.  Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing and
    keep themselves; so do rows with a null label.  Repeated rows are vectors that link
    with each other.  A null id links but names no component unless all of its
    component's ids are null, and is never kept.  No rows give none.
    """
    spark = vectors.sparkSession
    importable(spark)
    own = freeze(
        vectors.select(
            F.col(id_column).cast("long").alias("id"),
            F.col(vector_column).cast("array<double>").alias("v"),
            F.col(label_column).cast("string").alias("label"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("v").isNotNull() & finite
    valid = F.coalesce(valid & F.exists("v", lambda c: c != 0), F.lit(False))
    # Minus zero equals zero; + 0.0 gives both one form.
    plain = own.where(valid).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    equal = plain.groupBy("label", "v").agg(
        F.min("row").alias("vec"), F.min("id").alias("least"), F.count("*").alias("copies")
    )
    equal = freeze(equal, "distinct-vectors")
    sizes = equal.groupBy(F.size("v").alias("d"), "label").agg(F.count("*").alias("n"))
    widths = sizes.groupBy("d").agg(F.max("n").alias("n")).collect()
    plans = {r["d"]: plan_for(r["d"], r["n"], threshold, recall) for r in widths}
    probes = PROBES if any(p.probes > 1 for p in plans.values()) else 1
    plans = {d: Plan(p.hashes, probes, p.tables, threshold) for d, p in plans.items()}
    keyed = dealt_evenly(equal.select("vec", "label", "v", "copies"), 2000).mapInArrow(
        _emit_keys(plans),
        "vec long, label string, place int, code long, v array<double>, "
        "keys array<bigint>, copies long",
    )
    key = F.xxhash64("label", F.size("v"), "place", "code")
    slim = keyed.withColumn("key", key)
    dealt = paired_blocks(shared_keys(slim, 1024), "vec")
    group = ["key", "block_a", "block_b", "side"]
    dealt = dealt.select(*group, "vec", "label", "place", "code", "v", "keys", "copies")
    found = dealt.mapInArrow(_compare(threshold, probes), "a long, b long, n long")
    found = freeze(found, "vector-links")
    roots = freeze(connected_components(found.select("a", "b")), "vector-roots")
    least = equal.select(F.col("vec").alias("node"), "least")
    of_root = roots.join(least, "node").groupBy("root").agg(F.min("least").alias("joint"))
    joint = roots.join(of_root, "root").select(F.col("node").alias("vec"), "joint")
    counts = found.groupBy(F.col("a").alias("vec")).agg(F.sum("n").alias("n"))
    named = (
        equal.join(joint, "vec", "left")
        .join(counts, "vec", "left")
        .select(
            F.col("label").alias("own_label"),
            F.col("v").alias("own_v"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("joint", "least").alias("component"),
        )
    )
    linked = plain.join(
        named, (F.col("label") == F.col("own_label")) & (F.col("v") == F.col("own_v"))
    ).select("id", "n_links", F.col("component").alias("component_id"))
    alone = own.where(~valid).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
