"""How far sources of one language differ in their words: an audit by minimal perfect hashes.

First pass: exact document frequencies.  Tasks count a language's terms in a batch of
documents and pass on one row per distinct term; terms in enough documents are kept.
Then the kept terms of a language are dealt by hash into shards, and every shard gets a
minimal perfect hash: a displacement per bucket sends each of ``n`` terms to a slot of
its own below ``n``.  Terms that were not kept reach slots too, so the shard stores its
terms by slot and a look-up compares them.

Second pass: shards are broadcast in chunks of bounded bytes, each holding neighbouring
shards of few languages; a chunk's pass reads the texts of those languages only and adds
up occurrences in one dense vector of slots per group (language, source).  Vectors are
passed on when a bound of cells is reached, in ranges of slots: a row holds a group's
non-zero slots of one range.  Rows of a group and range are added up in one vector.

Shares are whole numbers, so no figure depends on the order of addition.  Pairs of
sources are compared in tiles: a range of slots by two blocks of sources.  A group's terms
are ranked range by range, and the first of every range once more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import freeze, importable

MIN_DOCS = 10
TOP_TERMS = 10
SHARD_KEYS = 50_000
SHARD_BYTES = 2 << 20
CHUNK_BYTES = 32 << 20  # of shards broadcast together, and one shard more
HELD_TERMS = 500_000  # distinct terms that a task holds before it passes counts on
HELD_CELLS = 4_000_000  # slots of all groups that a task holds
SLOT_RANGE, SOURCE_BLOCK = 2048, 128  # a tile of the comparison of sources
SHARD_SEED = 42  # of Spark's xxhash64, which deals terms to shards
MOST_TRIES = 5_000
LISTED_LANGS = 1_000

# Bytes 0x00-0x40, 0x5B-0x60 and 0x7B-0x7F separate terms, A-Z are lower-cased.
_SEPARATORS = {*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_FOLDED = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order; other characters than ASCII belong to terms."""
    return raw.translate(_FOLDED).split()


# --- minimal perfect hash -------------------------------------------------------------


def _mixed(h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    """Another 64-bit hash of ``h`` for displacement ``d``."""
    x = h + np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(keys: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(h, 0) % np.uint64(n)).astype(np.int64)


def slots_of(h: np.ndarray, displacements: np.ndarray) -> np.ndarray:
    """The slot of every hash; any hash gets one, so the stored key must be compared."""
    n = len(displacements)
    d = displacements[_buckets(h, n)].astype(np.int64)
    moved = (_mixed(h, np.maximum(d, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -1 - d, moved)


def _displaced(h: np.ndarray) -> np.ndarray | None:
    """A displacement per bucket that sends all hashes to different slots, if found.

    Large buckets first; buckets of one size try a displacement together, and those
    whose slots are free and wanted by no earlier bucket take them.  A bucket of one
    key points to a free slot directly, as a negative number.
    """
    n = len(h)
    bucket = _buckets(h, n)
    sizes = np.bincount(bucket, minlength=n)
    order = np.argsort(bucket, kind="stable")
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(n, np.int32)
    taken = np.zeros(n, bool)
    owner = np.full(n, n, np.int64)
    for size in range(int(sizes.max()), 1, -1):
        own = np.flatnonzero(sizes == size)
        keys = h[order[starts[own][:, None] + np.arange(size)]]
        for d in range(1, MOST_TRIES):
            if not len(own):
                break
            slots = (_mixed(keys, d) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(slots, axis=1)
            free = ~taken[slots].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            tried = np.flatnonzero(free)
            np.minimum.at(owner, slots[tried], tried[:, None])
            won = tried[(owner[slots[tried]] == tried[:, None]).all(axis=1)]
            owner[slots[tried]] = n
            taken[slots[won]] = True
            out[own[won]] = d
            left = np.ones(len(own), bool)
            left[won] = False
            own, keys = own[left], keys[left]
        if len(own):
            return None
    alone = np.flatnonzero(sizes == 1)
    out[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]
    return out


def perfect_hash(keys: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, slot of each key) for different keys; slots fill 0 to n - 1."""
    for seed in range(SHARD_SEED, SHARD_SEED + 100):
        h = hashes(keys, seed)
        if len(np.unique(h)) < len(h):
            continue  # two keys share a hash under this seed
        found = _displaced(h)
        if found is not None:
            return seed, found, slots_of(h, found)
    raise ValueError("no perfect hash found; are the keys different?")


# --- first pass -----------------------------------------------------------------------


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def passed_on():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(counts), pa.string()),
                    pa.array(list(counts), pa.binary()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["lang", "term", "n"],
            )

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        for k, lang in enumerate(langs):
            own = held.get(lang)
            if own is None:
                own = held[lang] = Counter()
            own.update(set(terms(texts[k].as_py())))
            if k % 64 == 0 and sum(map(len, held.values())) > HELD_TERMS:
                yield from passed_on()
                held.clear()
    yield from passed_on()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` documents (rows) of the language."""
    counted = docs.select("lang", "text").mapInArrow(
        _document_counts, "lang string, term binary, n long"
    )
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


_SHARD = "lang string, shard int, shards int, seed int, n int, displacements binary, lengths binary, terms binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (lang, shard) of rows sorted by it."""
    own, keys = None, []

    def built():
        seed, displacements, slots = perfect_hash(keys)
        by_slot = [keys[k] for k in np.argsort(slots)]
        lengths = np.array([len(k) for k in by_slot], "<i4")
        row = {"lang": own[0], "shard": own[1], "shards": own[2], "seed": seed, "n": len(keys)}
        row |= {"displacements": displacements.astype("<i4").tobytes(), "lengths": lengths.tobytes()}
        return pa.RecordBatch.from_pylist([row | {"terms": b"".join(by_slot)}], schema=_ARROW_SHARD)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("lang", "shard", "shards", "term")]
        for lang, shard, shards, term in zip(*columns):
            if own != (lang, shard, shards):
                if keys:
                    yield built()
                own, keys = (lang, shard, shards), []
            keys.append(term)
    if keys:
        yield built()


_ARROW_SHARD = pa.schema(
    [
        ("lang", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()), ("seed", pa.int32()),
        ("n", pa.int32()), ("displacements", pa.binary()), ("lengths", pa.binary()), ("terms", pa.binary()),
    ]
)


def shards_of(kept: DataFrame) -> DataFrame:
    """The kept terms as perfect hashes, one row per shard; ``base`` is its first slot in the language.

    ``chunk`` numbers shards that are broadcast together.
    """
    sizes = kept.groupBy("lang").agg(
        F.count("*").alias("v"), F.sum(F.length("term")).alias("bytes")
    )
    need = F.greatest(F.col("v") / F.lit(float(SHARD_KEYS)), F.col("bytes") / F.lit(float(SHARD_BYTES)))
    sizes = sizes.select("lang", F.ceil(need).cast("int").alias("shards"))
    dealt = kept.join(sizes, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "shards", "term"
    )
    dealt = dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term")
    built = freeze(dealt.mapInArrow(_build, _SHARD), "term-shards")
    # One row per shard: small enough to be numbered in one place.
    cost = F.length("terms") + F.length("displacements") + F.length("lengths")
    listed = built.select("lang", "shard", "n", cost.cast("long").alias("cost"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_lang = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    every = before.orderBy("lang", "shard")
    zero = F.lit(0).cast("long")
    numbered = listed.select(
        "lang",
        "shard",
        F.coalesce(F.sum("n").over(in_lang), zero).alias("base"),
        F.floor(F.coalesce(F.sum("cost").over(every), zero) / F.lit(float(CHUNK_BYTES))).alias("chunk"),
    )
    return freeze(built.join(numbered, ["lang", "shard"]), "numbered-shards")


# --- second pass ----------------------------------------------------------------------


class Shard:
    """A perfect hash with its stored terms; ``first`` is its place in a chunk's vectors."""

    def __init__(self, row, first: int):
        self.seed, self.n, self.first, self.base = row["seed"], row["n"], first, row["base"]
        self.displacements = np.frombuffer(bytes(row["displacements"]), "<i4")
        ends = np.cumsum(np.frombuffer(bytes(row["lengths"]), "<i4"), dtype=np.int64)
        flat, bounds = bytes(row["terms"]), [0, *ends.tolist()]
        self.terms = [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def find(self, keys: list[bytes], h: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        if self.seed != SHARD_SEED:
            h = hashes(keys, self.seed)
        slots = slots_of(h, self.displacements)
        stored = self.terms
        same = np.fromiter((stored[s] == k for s, k in zip(slots.tolist(), keys)), bool, len(keys))
        return np.where(same, slots, -1)


class Lexicon:
    """A chunk's shards of one language."""

    def __init__(self, rows: list):
        self.shards_in_all = rows[0]["shards"]
        self.shards: dict[int, Shard] = {}
        self.size = 0
        for row in sorted(rows, key=lambda r: r["shard"]):
            self.shards[row["shard"]] = Shard(row, self.size)
            self.size += row["n"]
        # Place in the vectors to slot in the language.
        self.slots = np.concatenate([s.base + np.arange(s.n) for s in self.shards.values()])

    def places(self, keys: list[bytes]) -> np.ndarray:
        """Each key's place in a group's vector, -1 for keys of other chunks or of none."""
        h = hashes(keys, SHARD_SEED)
        shard = np.mod(h.view(np.int64), self.shards_in_all)
        out = np.full(len(keys), -1, np.int64)
        for number, own in self.shards.items():
            at = np.flatnonzero(shard == number)
            if len(at):
                found = own.find([keys[k] for k in at.tolist()], h[at])
                out[at] = np.where(found >= 0, own.first + found, -1)
        return out


def _recount(shipped):
    """Occurrences by (lang, source, slot), summed in a dense vector per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        for row in shipped.value:
            by_lang.setdefault(row["lang"], []).append(row)
        lexicons = {lang: Lexicon(rows) for lang, rows in by_lang.items()}
        vectors: dict[tuple[str, str], np.ndarray] = {}

        def passed_on():
            for (lang, source), vector in vectors.items():
                at = np.flatnonzero(vector)
                slots, counts = lexicons[lang].slots[at], vector[at]
                part = slots // SLOT_RANGE
                cuts = np.flatnonzero(np.diff(part)) + 1
                parts = part[np.append(0, cuts)] if len(part) else part
                inside = (slots - part * SLOT_RANGE).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(parts), pa.string()),
                        pa.array([source] * len(parts), pa.string()),
                        pa.array(parts.astype(np.int32), pa.int32()),
                        pa.array([x.tobytes() for x in np.split(inside, cuts)][: len(parts)], pa.binary()),
                        pa.array([x.tobytes() for x in np.split(counts, cuts)][: len(parts)], pa.binary()),
                    ],
                    ["lang", "source", "range", "slots", "counts"],
                )

        def add(found: dict[tuple[str, str], Counter]) -> None:
            for lang in {k[0] for k in found}:
                lexicon = lexicons[lang]
                groups = {k: c for k, c in found.items() if k[0] == lang}
                distinct = list(set().union(*groups.values()))
                place = dict(zip(distinct, lexicon.places(distinct).tolist()))
                for key, counts in groups.items():
                    vector = vectors.get(key)
                    if vector is None:
                        vector = vectors[key] = np.zeros(lexicon.size, np.int64)
                    at = np.fromiter(map(place.__getitem__, counts), np.int64, len(counts))
                    n = np.fromiter(counts.values(), np.int64, len(counts))
                    vector[at[at >= 0]] += n[at >= 0]

        for batch in batches:
            found: dict[tuple[str, str], Counter] = {}
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            texts, held = batch.column("text"), 0
            for k, key in enumerate(keys):
                if key[0] not in lexicons:
                    continue
                own = found.get(key)
                if own is None:
                    own = found[key] = Counter()
                before = len(own)
                own.update(terms(texts[k].as_py()))
                held += len(own) - before
                if held > HELD_TERMS:
                    add(found)
                    found, held = {}, 0
                    if sum(map(len, vectors.values())) > HELD_CELLS:
                        yield from passed_on()
                        vectors.clear()
            add(found)
            if sum(map(len, vectors.values())) > HELD_CELLS:
                yield from passed_on()
                vectors.clear()
        yield from passed_on()

    return run


_CELLS = "lang string, source string, range int, slots binary, counts binary, n long"
_ARROW_CELLS = pa.schema(
    [
        ("lang", pa.string()), ("source", pa.string()), ("range", pa.int32()),
        ("slots", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()),
    ]
)


def _vector(slots: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(slots, "<u2"), np.frombuffer(counts, "<i8")


def _add_up(keys: tuple[str, ...]):
    """Rows sorted by ``keys``, added up: one row per key with its non-zero slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, out = None, np.zeros(SLOT_RANGE, np.int64), []

        def finished():
            at = np.flatnonzero(total)
            row = dict(zip(keys, own)) | {"slots": at.astype("<u2").tobytes()}
            return row | {"counts": total[at].tobytes(), "n": int(total.sum())}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "slots", "counts")]
            for *key, slots, counts in zip(*columns):
                if key != own:
                    if own is not None:
                        out.append(finished())
                    own = key
                    total[:] = 0
                at, n = _vector(slots, counts)
                total[at] += n  # slots of a row are different
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW_CELLS)
                out = []
        if own is not None:
            out.append(finished())
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW_CELLS)

    return run


def added_up(cells: DataFrame, *keys: str) -> DataFrame:
    """The cells of each key summed; ``source`` is null where it is not a key."""
    dealt = cells.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "slots", "counts").mapInArrow(_add_up(keys), _CELLS)


def recounted(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, source, range, slots, counts, n): every group's occurrences of kept terms."""
    spark = docs.sparkSession
    last = shards.agg(F.max("chunk")).first()[0]
    parts = []
    for chunk in range(-1 if last is None else int(last) + 1):
        rows = [r.asDict() for r in shards.where(F.col("chunk") == chunk).collect()]
        if not rows:  # a shard larger than a chunk skips a number
            continue
        shipped = spark.sparkContext.broadcast(rows)
        langs = list({r["lang"] for r in rows})
        # Tasks skip other languages; a short list of them keeps their texts in the scan.
        own = docs.where(F.col("lang").isin(langs)) if len(langs) <= LISTED_LANGS else docs
        found = own.mapInArrow(
            _recount(shipped), "lang string, source string, range int, slots binary, counts binary"
        )
        parts.append(freeze(added_up(found, "lang", "source", "range"), f"recount-{chunk}"))
        shipped.unpersist()
    if not parts:
        return spark.createDataFrame([], _CELLS)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    # A range that two chunks share has a row from each.
    return out if len(parts) == 1 else freeze(added_up(out, "lang", "source", "range"), "recounted")


def _range_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stored terms by range of slots; a shard may begin and end inside a range."""
    for batch in batches:
        for row in batch.to_pylist():
            own = Shard(row, 0)
            first = row["base"]
            cuts = [first, *range((first // SLOT_RANGE + 1) * SLOT_RANGE, first + own.n, SLOT_RANGE), first + own.n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]] * (len(cuts) - 1), pa.string()),
                    pa.array([a // SLOT_RANGE for a in cuts[:-1]], pa.int32()),
                    pa.array([a % SLOT_RANGE for a in cuts[:-1]], pa.int32()),
                    pa.array([own.terms[a - first : b - first] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.binary())),
                ],
                ["lang", "range", "at", "terms"],
            )


def _risen(top_terms: int):
    """Per row (a group's range) the terms whose share most exceeds the language's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                at, counts = _vector(row["slots"], row["counts"])
                every = np.zeros(SLOT_RANGE, np.int64)
                where, n = _vector(row["all_slots"], row["all_counts"])
                every[where] = n
                p, q = shares(counts, row["n_all"], row["v"]), shares(every[at], row["n_lang"], row["v"])
                value = (p - q) * (p - q) // (p + q)
                more = np.flatnonzero(p > q)
                if len(more) > top_terms:  # ties with the last one stay in
                    least = np.partition(value[more], -top_terms)[-top_terms]
                    more = more[value[more] >= least]
                named = sorted((-int(value[k]), row["terms"][at[k]]) for k in more)[:top_terms]
                own = {"lang": row["lang"], "source": row["source"]}
                out += [own | {"item": term.decode(), "value": -less} for less, term in named]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW_RISEN)

    return run


_RISEN = "lang string, source string, item string, value long"
_ARROW_RISEN = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]
)


# --- shares and their comparison --------------------------------------------------------


def shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 v)), by long division so that nothing overflows."""
    n, out, rest = total + 2 * v, np.zeros(len(counts), np.int64), counts.astype(np.int64) + 2
    for _ in range(3):
        out = out * 1000 + rest * 1000 // n
        rest = rest * 1000 % n
    return out + 1


def _tile(group: pa.Table) -> pa.Table:
    """Summed differences of the sources of two blocks over a range of slots."""
    rows = group.select(["source", "side", "n_all", "v", "range", "slots", "counts"]).to_pylist()
    a, b = group["block_a"][0].as_py(), group["block_b"][0].as_py()
    lang = group["lang"][0].as_py()
    width = max(0, min(SLOT_RANGE, rows[0]["v"] - rows[0]["range"] * SLOT_RANGE))
    p = np.ones((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        counts = np.zeros(width, np.int64)
        at, n = _vector(row["slots"] or b"", row["counts"] or b"")
        counts[at] = n
        if width:
            p[k] = shares(counts, row["n_all"], row["v"])
    side = np.array([r["side"] for r in rows])
    one, other = np.flatnonzero(side == a), np.flatnonzero(side == b)
    out: tuple[list, list, list] = ([], [], [])
    for i in one.tolist():
        away = p[other] - p[i]
        value = (away * away // (p[other] + p[i])).sum(axis=1).tolist()
        for j, f in zip(other.tolist(), value):
            if i != j:
                ends = [(i, j)] if a == b else [(i, j), (j, i)]
                for x, y in ends:
                    for column, cell in zip(out, (rows[x]["source"], rows[y]["source"], f)):
                        column.append(cell)
    return pa.table(
        {
            "lang": pa.array([lang] * len(out[0]), pa.string()),
            "source": pa.array(out[0], pa.string()),
            "item": pa.array(out[1], pa.string()),
            "value": pa.array(out[2], pa.int64()),
        }
    )


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language."""
    in_lang = Window.partitionBy("lang")
    blocks = F.ceil(F.count("*").over(in_lang) / F.lit(float(SOURCE_BLOCK))).cast("int")
    ranges = F.greatest(F.ceil(F.col("v") / F.lit(float(SLOT_RANGE))), F.lit(1))
    number = F.row_number().over(in_lang.orderBy("source")) - 1
    placed = groups.select(
        "lang", "source", "n_all", "v", blocks.alias("blocks"),
        F.floor(number / F.lit(float(SOURCE_BLOCK))).cast("int").alias("side"),
        F.explode(F.sequence(F.lit(0), ranges.cast("int") - 1)).alias("range"),
    )
    dealt = (
        placed.join(cells.drop("n"), ["lang", "source", "range"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "lang", "range",
            F.least("side", "other").alias("block_a"), F.greatest("side", "other").alias("block_b"),
            "source", "side", "n_all", "v", "slots", "counts",
        )
    )
    compared = dealt.groupBy("lang", "range", "block_a", "block_b").applyInArrow(
        _tile, "lang string, source string, item string, value long"
    )
    return compared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far a language's sources differ.

    A language keeps the terms in at least ``min_docs`` of its documents.  A group's share
    of a kept term is 1 + floor(10^9 * (count + 2) / (N + 2 V)); two shares p and q differ
    by floor((p - q)^2 / (p + q)).  Part ``pair`` holds the sum over all kept terms for every
    other source of the language; part ``term`` the ``top_terms`` terms that a source has more
    of than its language as a whole.  Ranks fall with the value; ties follow the item.

    Null texts, languages and sources count as ''.  Repeated rows are documents of their own.
    A group without terms is compared like any other; a language without kept terms has pairs
    of value 0 and no terms.  No rows give none.  Columns other than the three named are not read.
    """
    importable(docs.sparkSession)

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    own = docs.select(
        text(lang_column).alias("lang"),
        text(source_column).alias("source"),
        text(text_column).cast("binary").alias("text"),
    )
    kept = freeze(kept_terms(own, min_docs), "kept-terms")
    shards = shards_of(kept.select("lang", "term"))
    cells = recounted(own, shards)
    sizes = shards.groupBy("lang").agg(F.sum(F.col("n").cast("long")).alias("v"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    zero = F.lit(0).cast("long")
    groups = (
        own.groupBy("lang", "source").agg(F.lit(1).alias("one"))
        .join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select(
            "lang", "source",
            F.coalesce("n_all", zero).alias("n_all"), F.coalesce("v", zero).alias("v"),
        )
    )
    groups = freeze(groups, "groups")
    pairs = _pairs(groups, cells)

    whole = groups.groupBy("lang").agg(F.sum("n_all").alias("n_lang"))
    everywhere = added_up(cells, "lang", "range").select(
        "lang", "range", F.col("slots").alias("all_slots"), F.col("counts").alias("all_counts")
    )
    pieces = shards.select("lang", "base", "seed", "n", "displacements", "lengths", "terms").mapInArrow(
        _range_terms, "lang string, range int, at int, terms array<binary>"
    )
    listed = F.sort_array(F.collect_list(F.struct("at", "terms")))  # a range's terms at most
    named = pieces.groupBy("lang", "range").agg(F.flatten(F.transform(listed, lambda x: x["terms"])).alias("terms"))
    risen = (
        cells.drop("n")
        .join(groups, ["lang", "source"])
        .join(whole, "lang")
        .join(everywhere, ["lang", "range"])
        .join(named, ["lang", "range"])
        .mapInArrow(_risen(top_terms), _RISEN)
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(part: str, rows: DataFrame) -> DataFrame:
        return rows.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
        )

    return ranked("pair", pairs).union(ranked("term", risen).where(F.col("rank") <= top_terms))
