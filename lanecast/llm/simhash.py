"""SimHash near-duplicates found by Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  The
perfect binary Golay code (23, 12) puts every word of up to 23 bits within three
flips of one codeword.  A segment's *fuzzy keys* are the codeword indices of all
words at most one flip away from it (about five); two segments that differ in
at most two bits share the word between them, hence a key.

Where two fingerprints differ in at most four bits, either

* a segment is free of errors, and one of the other two holds at most two: a
  table for each (exact segment, fuzzy segment), six in all; or
* every segment has an error, so two have exactly one, which leaves one half of
  each intact, and the third has at most two: a table for each (fuzzy segment,
  half, half), twelve in all.

So every pair within the distance shares a key, and each key holds 33 bits or
more, so chance collisions stay rare at any size.  Keys that several
fingerprints share are compared in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import close_pairs, forest, paired_blocks, shared_keys, whole_groups
from .components import connected_components
from .tables import dealt_evenly, freeze, importable, release_memory, releasing

# The contract's shingles and distance, the hash's seed, the code.
SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
FINGERPRINTS_PER_TASK = 20_000  # each makes about a hundred keys
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the shingles' XXH64 as a signed 64-bit integer; no word gives 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begins = np.cumsum(lengths + 1) - lengths - 1
    ends = begins + lengths
    k = min(shingle_words, len(words))
    spans = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):
        octets = hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(column: str, shingle_words: int = SHINGLE_WORDS):
    """The fingerprint as a column (long); whole texts, null like empty."""

    @F.pandas_udf("long")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                found = (fingerprint(t, shingle_words) for t in texts)
                yield pd.Series(np.fromiter(found, np.int64, len(texts)))
        finally:
            release_memory()

    return of_texts(F.col(column).cast("string"))


@cache
def codewords() -> np.ndarray:
    """For every 23-bit word, the 12-bit index of the nearest Golay codeword."""

    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.astype(np.int32)
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
        return rest

    flips = [0]
    for a in range(23):
        flips.append(1 << a)
        for b in range(a):
            flips.append(1 << a | 1 << b)
            flips.extend(1 << a | 1 << b | 1 << c for c in range(b))
    errors = np.zeros(2048, dtype=np.int32)
    errors[syndrome(np.array(flips))] = flips
    each = syndrome(1 << np.arange(23, dtype=np.int32))
    syndromes = np.zeros(1, dtype=np.int32)
    for bit in range(23):  # the syndrome is linear: double the table bit by bit
        syndromes = np.concatenate([syndromes, syndromes ^ each[bit]])
    nearest = np.arange(1 << 23, dtype=np.int32) ^ errors[syndromes]
    return (nearest >> 11).astype(np.uint16)


def fuzzy_keys(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of every word at most one flip from each segment, once each."""
    near = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(codewords()[segment[:, None] ^ near[None, :]], axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    row, at = np.nonzero(first)
    return row, found[row, at].astype(np.int64)


def keys_of(fingerprints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) of all eighteen tables; the table's number is part of the key."""
    bits = fingerprints.view(np.uint64)
    segments, halves, fuzzy = [], [], []
    for start, width in SEGMENTS:
        value = (bits >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
        segments.append(value)
        halves.append((value & 0x7FF, value >> 11))
        fuzzy.append(fuzzy_keys(value, width))
    table = 0
    for j in range(3):
        row, code = fuzzy[j]
        for i in range(3):
            if i != j:
                yield (table << 40) | (segments[i][row] << 12) | code, row
                table += 1
        a, b = (k for k in range(3) if k != j)
        for x in halves[a]:
            for y in halves[b]:
                yield (table << 40) | (x[row] << 23) | (y[row] << 12) | code, row
                table += 1


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy()
        for part in range(0, len(values), 4096):
            own = values[part : part + 4096]
            for key, row in keys_of(own):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "fp"])


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches):
            fp = rows["fp"].to_numpy()
            bits = fp.view(np.uint64)
            blocks = rows["block_a"].to_numpy(), rows["block_b"].to_numpy()
            labels = np.arange(len(fp))

            def close(i, j):
                return np.bitwise_count(bits[i] ^ bits[j]) <= max_bits

            for i, j in close_pairs(starts, rows["side"].to_numpy(), blocks, close):
                labels = forest(labels, i, j)
            moved = np.flatnonzero(labels != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[moved]), pa.array(fp[labels[moved]])], ["a", "b"]
            )

    return run


def fingerprint_links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that connect all distinct ``fp`` within ``max_bits`` (0 to 4) of each other.

    The links span the components; they aren't all pairs.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys are complete for at most 4 differing bits")
    spread = dealt_evenly(fingerprints.select("fp"), FINGERPRINTS_PER_TASK)
    keyed = spread.mapInArrow(releasing(_emit_keys), "key long, fp long")
    dealt = paired_blocks(shared_keys(keyed), "fp")
    dealt = dealt.select("key", "block_a", "block_b", "side", "fp")
    return dealt.mapInArrow(releasing(_compare(max_bits)), "a long, b long")


def simhash_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (hex) and ``component_id``.

    Documents link if their fingerprints differ in at most ``max_bits``; the
    component's id is the least document id reachable.  Exact copies share a
    fingerprint and enter the search once.  A null or empty text has fingerprint
    zero and links like any other.  A null id counts as a document without a name:
    it links others, but never names a component unless all ids are null (then
    null).  Repeated rows are returned as often as they came; no rows give none.
    Other columns are not read.
    """
    importable(docs.sparkSession)
    own = docs.select(
        F.col(id_column).alias("id"), simhash(text_column, shingle_words).alias("fp")
    )
    own = freeze(own, "fingerprints")
    least = freeze(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(least, max_bits))
    roots = freeze(roots.withColumnRenamed("node", "fp"), "roots")
    of_root = roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("joint"))
    joint = roots.join(of_root, "root").select("fp", "joint")
    named = least.join(joint, "fp", "left").select(
        "fp", F.coalesce("joint", "least").alias("component_id")
    )
    return own.join(named, "fp").select(
        F.col("id").alias(id_column),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
