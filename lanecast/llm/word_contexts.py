"""The Pitman-Yor model of ``pitman_yor`` with a restaurant for every training word.

The context of a token is the word before it, of a text's first token the end.  So a context
word's customers are its own occurrences, and the vocabulary is the only list of restaurants.

A pair (context, word) that occurs once has one table whatever is drawn.  Only pairs that
occur more often are seated anew in a sweep; by the draw's rule their tables depend on the
context's tables and the word's weight in the parent alone, both of the sweep before.
Scores use the means over the sweeps after the first ones: ``c - discount * tables`` of a
pair, tables of a context, the parent's probability of a word.  Means of distributions
that share their totals, they sum to one.

Data flow.  Words get numbers by their rank, which no layout changes, so draws are hashes of
numbers.  Blocks of texts, buckets of pairs (by a hash of both words, so frequent words are
spread) and shards of numbers exchange sorted arrays: a block's distinct pairs go to their
buckets once; in a sweep a bucket sends the sums of its tables by word and context to their
shards and gets totals back.  Nothing but a few sums reaches the driver, and no task holds more than
a block, a bucket or a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import pitman_yor as model
from .tables import freeze, releasing

PARTS = 4096  # words are numbered by part
PART_BITS = 40  # of a word's number in its part
SHARD_WORDS = 1 << 17

_KINDS = {
    "kind": pa.string(), "block": pa.int64(), "bucket": pa.int32(), "shard": pa.int32(),
    "x": pa.binary(), "y": pa.binary(), "z": pa.binary(), "v": pa.binary(),
}
_MESSAGE = "kind string, block long, bucket int, shard int, x binary, y binary, z binary, v binary"


def _message(kind, block=None, bucket=None, shard=None, x=None, y=None, z=None, v=None) -> tuple:
    return kind, block, bucket, shard, x, y, z, v


def _sent(messages: list[tuple]) -> pa.RecordBatch:
    columns = zip(*messages) if messages else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, _KINDS.values())], list(_KINDS)
    )


def pack(values: np.ndarray) -> bytes:
    """Values by byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.compress(planes.T.tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values.astype("<u8"), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def _mix(keys: np.ndarray) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """(key, its rows) of rows sorted by ``column``."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[column] != key:
                yield key, rows
                rows = []
            key = row[column]
            rows.append(row)
    if rows:
        yield key, rows


def _by_shard(ids: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(shard, numbers inside it, values) of ascending ``ids``."""
    if not len(ids):
        return
    shard = (ids // SHARD_WORDS).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(ids)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = int(shard[a])
        yield own, ids[a:b].astype(np.int64) - own * SHARD_WORDS, *(x[a:b] for x in values)


def _post(id_type: pa.DataType):
    """A block's distinct words with their training counts, its documents and tokens."""
    document = pa.struct([("id", id_type), ("train", pa.bool_()), ("n_tokens", pa.int64())])
    kinds = {
        "block": pa.int64(), "idx": pa.int32(), "word": pa.binary(), "n": pa.int64(),
        "body": pa.binary(), "docs": pa.list_(document),
    }
    most_tokens, most_docs = model.BLOCK_TOKENS, model.BLOCK_DOCS

    def rows_of(size: int, **columns) -> pa.RecordBatch:
        arrays = [columns[c] if c in columns else pa.nulls(size, k) for c, k in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, list(kinds))

    def block_of(ids: dict[bytes, int], rows: list, texts: list[np.ndarray], train: list[bool]):
        sizes = np.array([len(t) for t in texts])
        word, m = np.concatenate(texts), len(ids)
        first = rows[0][0]  # a block is named by its first row
        n = np.bincount(word[np.repeat(np.array(train), sizes)], minlength=m)
        yield rows_of(
            m,
            block=pa.array(np.full(m, first)),
            idx=pa.array(np.arange(m, dtype=np.int32)),
            word=pa.array(list(ids), pa.binary()),
            n=pa.array(n.astype(np.int64)),
        )
        listed = [
            {"id": i, "train": learn, "n_tokens": int(k)} for (_, i), learn, k in zip(rows, train, sizes)
        ]
        yield rows_of(
            1,
            block=pa.array([first]),
            body=pa.array([zstandard.compress(word.astype("<u4").tobytes(), 1)], pa.binary()),
            docs=pa.array([listed], pa.list_(document)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, texts, train, total = {}, [], [], [], 0
        for more, words, learn in model._portions(batches):
            n = sum(map(len, words))
            if rows and (total + n > most_tokens or len(rows) + len(more) > most_docs):
                yield from block_of(ids, rows, texts, train)
                ids, rows, texts, train, total = {}, [], [], [], 0
            add = ids.setdefault
            texts += [np.fromiter((add(w, len(ids)) for w in t), np.int32, len(t)) for t in words]
            rows += more
            train += learn
            total += n
        if rows:
            yield from block_of(ids, rows, texts, train)

    return run


def _number():
    """Number the training words of each part; tell every block its words' numbers and counts.

    Rows are sorted by part and word; a word has a row per block.
    """
    most = model.HELD_ANSWERS

    def told(held: list[tuple]) -> list[tuple]:
        block, idx, number, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(block, kind="stable")
        names, firsts = np.unique(block[order], return_index=True)
        return [
            _message("words", name, x=pack(idx[own].astype("<u4")), y=pack_sorted(number[own]), z=pack(c[own]))
            for name, own in zip(names.tolist(), np.split(order, firsts[1:]))
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(PARTS, np.int64)
        tokens = once = twice = 0
        open_, held, n_held = None, [], 0
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            rows = [b for b in (open_, batch) if b is not None]
            if not rows:
                break
            rows = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            run = model._runs(rows.column("word"))
            if batch is not None:  # the last word may go on
                whole = int(np.searchsorted(run, run[-1]))
                open_, rows, run = rows.slice(whole), rows.slice(0, whole), run[:whole]
                if not whole:
                    continue
            firsts = np.flatnonzero(np.diff(run, prepend=-1))
            part = rows.column("part").to_numpy()[firsts].astype(np.int64)
            c = np.add.reduceat(rows.column("n").to_numpy(), firsts)
            known = c > 0
            before = np.cumsum(known) - known
            inside = before - before[np.searchsorted(part, part)] + found[part]
            number = (part << PART_BITS) | inside
            found += np.bincount(part[known], minlength=PARTS)
            tokens, once, twice = tokens + int(c.sum()), once + int((c == 1).sum()), twice + int((c == 2).sum())
            told_rows = known[run]
            held.append(
                (
                    rows.column("block").to_numpy()[told_rows],
                    rows.column("idx").to_numpy()[told_rows],
                    number[run][told_rows],
                    c[run][told_rows],
                )
            )
            n_held += len(held[-1][0])
            if n_held > most:
                yield _sent(told(held))
                held, n_held = [], 0
        if n_held:
            yield _sent(told(held))
        yield _sent([_message("stats", x=pack(found), y=pack(np.array([tokens, once, twice])))])

    return run


class _Block:
    """A block's tokens with the numbers of its words (-1: not in training)."""

    def __init__(self, rows: list[dict], offsets: np.ndarray):
        (body,) = [r for r in rows if r["body"] is not None]
        self.word = np.frombuffer(zstandard.decompress(body["body"]), "<u4")
        self.docs = body["docs"]
        self.n_tokens = np.array([d["n_tokens"] for d in self.docs])
        self.starts = np.cumsum(self.n_tokens) - self.n_tokens
        m = int(self.word.max()) + 1
        self.ids, self.c = np.full(m, -1, np.int64), np.zeros(m, np.int64)
        for r in rows:
            if r["kind"] == "words":
                idx, number = unpack(r["x"], "<u4"), unpack_sorted(r["y"]).astype(np.int64)
                self.ids[idx] = offsets[number >> PART_BITS] + (number & ((1 << PART_BITS) - 1))
                self.c[idx] = unpack(r["z"], "<i8")

    def context(self) -> np.ndarray:
        """Word before each token, the end before a text."""
        out = np.empty_like(self.word)
        out[1:] = self.word[:-1]
        out[self.starts] = self.word[-1]
        return out

    def pairs(self, n_buckets: int):
        """(tokens whose pair may be known, place of their pair, pairs by bucket and key, buckets)."""
        w = self.ids[self.word]
        u = self.ids[self.context()]
        good = (u >= 0) & (w >= 0)
        key = (u[good].astype(np.uint64) << np.uint64(32)) | w[good].astype(np.uint64)
        del u, w
        keys, at = np.unique(key, return_inverse=True)
        bucket = (_mix(keys) % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return good, place[at], keys[order], bucket[order]


def _ask(offsets: np.ndarray, n_buckets: int):
    """A block's distinct pairs with training counts for their buckets, its words for their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _groups(batches, "block"):
            block = _Block(rows, offsets)
            good, at, keys, bucket = block.pairs(n_buckets)
            train = np.repeat([bool(d["train"]) for d in block.docs], block.n_tokens)
            n = np.bincount(at[train[good]], minlength=len(keys))
            cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
            yield _sent(
                [
                    _message("pairs", name, b, x=pack_sorted(keys[i:j]), y=pack(n[i:j]))
                    for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                    if j > i
                ]
                + [
                    _message("ask", name, shard % n_buckets, shard, x=pack_sorted(own))
                    for shard, own in _by_shard(np.sort(block.ids[block.ids >= 0]))
                ]
            )

    return run


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sums(kind: str, bucket: int | None, keys: np.ndarray, t: np.ndarray) -> list[tuple]:
    """Tables by context and by word, for their shards."""
    u, w = _split(keys)
    ids = np.unique(np.concatenate([u, w]))
    of_context = np.bincount(np.searchsorted(ids, u), t, len(ids)).astype(np.int64)
    of_word = np.bincount(np.searchsorted(ids, w), t, len(ids)).astype(np.int64)
    return [
        _message(kind, None, bucket, shard, pack_sorted(own), pack(a), pack(b))
        for shard, own, a, b in _by_shard(ids, of_context, of_word)
    ]


def _merge():
    """Counts of a bucket's pairs; blocks' questions name a pair by its place among the repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            passed = [tuple(r.values()) for r in rows if r["kind"] == "ask"]
            if passed:
                yield _sent(passed)
            rows = [r for r in rows if r["kind"] == "pairs"]
            if not rows:
                continue
            parts = [unpack_sorted(r["x"]) for r in rows]
            cuts = np.cumsum([0] + [len(p) for p in parts])
            keys, at = np.unique(np.concatenate(parts), return_inverse=True)
            del parts
            n = np.concatenate([unpack(r["y"], "<i8") for r in rows])
            c = np.bincount(at, n, len(keys)).astype(np.int64)
            code = np.minimum(c, 2).astype(np.uint8)
            place = np.cumsum(code == 2) - 1
            for r, i, j in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist()):
                own = at[i:j]
                told = code[own]
                repeated = pack_sorted(place[own[told == 2]])
                yield _sent([_message("question", r["block"], bucket, x=pack(told), y=repeated)])
            more = code == 2
            yield _sent(
                [
                    _message("repeated", None, bucket, x=pack_sorted(keys[more]), y=pack(c[more])),
                    _message("stats", x=pack(np.array([(c == 1).sum(), (c == 2).sum()], np.int64))),
                ]
                + _sums("single", None, keys[code == 1], np.ones(int((code == 1).sum())))
                + _sums("tables", bucket, keys[more], np.ones(int(more.sum())))
            )

    return run


class Sweeps:
    """What all tasks know: discounts and the parent's totals by sweep."""

    def __init__(self, vocabulary: int, discounts: tuple[float, float]):
        self.discounts, self.base = discounts, 1.0 / (vocabulary + 1)
        self.tables: list[int] = []  # of all contexts, which are the parent's customers
        self.parent_tables: list[int] = []

    def spare(self, sweep: int) -> float:
        return (model.STRENGTHS[0] + self.discounts[0] * self.parent_tables[sweep]) * self.base

    def unknown(self, sweep: int) -> float:
        return self.spare(sweep) / (model.STRENGTHS[0] + self.tables[sweep])

    def parent(self, sweep: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words."""
        seated = customers - self.discounts[0] * tables
        return (seated + self.spare(sweep)) / (model.STRENGTHS[0] + self.tables[sweep])

    def draw_parent(self, sweep: int, customers: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if not sweep:
            return np.ones(len(ids), np.int64)
        weight = np.full(len(ids), self.spare(sweep - 1))
        return model.sample_tables(customers, weight, self.discounts[0], _mix(ids), 2 * sweep + 1)

    def draw(self, sweep: int, c: np.ndarray, tables: np.ndarray, parent: np.ndarray, keys: np.ndarray):
        """Tables of pairs, from their context's tables and word's probability of the sweep before."""
        d1, s1 = self.discounts[1], model.STRENGTHS[1]
        return model.sample_tables(c, (s1 + d1 * tables) * parent, d1, _mix(keys), 2 * sweep)


def _seat(sweeps: Sweeps, sweep: int):
    """A shard's totals after a sweep, told to the buckets that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            # Tables by context, by word; of pairs that occur once, of all.
            sums = {k: np.zeros((2, SHARD_WORDS), np.int64) for k in ("single", "tables")}
            asked = []
            for r in rows:
                ids = unpack_sorted(r["x"]).astype(np.int64)
                sums[r["kind"]][0, ids] += unpack(r["y"], "<i8")
                sums[r["kind"]][1, ids] += unpack(r["z"], "<i8")
                if r["kind"] == "tables":
                    asked.append((r["bucket"], r["x"], ids))
            tables, customers = sums["single"] + sums["tables"]
            parent = np.zeros(SHARD_WORDS, np.int64)
            some = np.flatnonzero(customers)
            parent[some] = sweeps.draw_parent(sweep, customers[some], some + shard * SHARD_WORDS)
            out = [_message("stats", x=pack(np.array([customers.sum(), parent.sum()])))]
            if not sweep:
                own = np.flatnonzero(sums["single"].any(axis=0))
                a, b = sums["single"][:, own]
                out.append(_message("single", None, None, shard, pack_sorted(own), pack(a), pack(b)))
            if sweep > model.BURN_IN:
                out.append(
                    _message(f"sample{sweep}", None, None, shard, pack(tables), pack(customers), pack(parent))
                )
            yield _sent(out)
            if sweep < model.SWEEPS:
                for bucket, x, ids in asked:
                    reply = pack(tables[ids]), pack(customers[ids]), pack(parent[ids])
                    yield _sent([_message("reply", None, bucket, shard, x, *reply)])

    return run


def _draw(sweeps: Sweeps, sweep: int):
    """Seat a bucket's repeated pairs anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            (own,) = [r for r in rows if r["kind"] == "repeated"]
            keys, c = unpack_sorted(own["x"]), unpack(own["y"], "<i8")
            if not len(keys):
                continue
            replies = sorted((r for r in rows if r["kind"] == "reply"), key=lambda r: r["shard"])
            ids = np.concatenate(
                [unpack_sorted(r["x"]).astype(np.int64) + r["shard"] * SHARD_WORDS for r in replies]
            )
            tables, customers, parent = (
                np.concatenate([unpack(r[name], "<i8") for r in replies]) for name in ("y", "z", "v")
            )
            u, w = (np.searchsorted(ids, x) for x in _split(keys))
            p = sweeps.parent(sweep - 1, customers, parent)
            t = sweeps.draw(sweep, c, tables[u], p[w], keys)
            out = _sums("tables", bucket, keys, t)
            if sweep > model.BURN_IN:
                out.append(_message("seated", None, bucket, x=pack(t)))
            yield _sent(out)

    return run


def _tell_pairs(discount: float):
    """For each block and bucket, ``c - discount * tables`` of the asked pairs, 0 if not in training."""
    samples = model.SWEEPS - model.BURN_IN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            (own,) = [r for r in rows if r["kind"] == "repeated"]
            seated = unpack(own["y"], "<i8").astype(np.float64)
            for r in rows:
                if r["kind"] == "seated":
                    seated -= discount / samples * unpack(r["x"], "<i8")
            seated = seated.astype("<f4")
            for r in rows:
                if r["kind"] == "question":
                    code = unpack(r["x"], "u1")
                    told = np.where(code == 1, 1 - discount, 0).astype("<f4")
                    told[code == 2] = seated[unpack_sorted(r["y"]).astype(np.int64)]
                    yield _sent([_message("pair", r["block"], bucket, x=pack(told))])

    return run


def _tell_words(sweeps: Sweeps):
    """For each block and shard, the asked words' parent probabilities and tables as contexts."""
    samples = range(model.BURN_IN + 1, model.SWEEPS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            found = {r["kind"]: r for r in rows if r["kind"] != "ask"}
            parent, tables = np.zeros(SHARD_WORDS), np.zeros(SHARD_WORDS)
            for k in samples:
                own = found[f"sample{k}"]
                customers, seated = unpack(own["y"], "<i8"), unpack(own["z"], "<i8")
                parent += sweeps.parent(k, customers, seated) / len(samples)
                tables += unpack(own["x"], "<i8") / len(samples)
            for r in rows:
                if r["kind"] == "ask":
                    ids = unpack_sorted(r["x"]).astype(np.int64)
                    told = pack(parent[ids].astype("<f4")), pack(tables[ids].astype("<f4"))
                    yield _sent([_message("word", r["block"], None, shard, *told)])

    return run


def _add_up(sweeps: Sweeps, offsets: np.ndarray, n_buckets: int, train_tokens: int, id_type: pa.DataType):
    """Every document of a block, from its tokens and all answers."""
    vocabulary = int(offsets[-1])
    below = np.log10(train_tokens + 0.5 * (vocabulary + 1))
    d1, s1 = sweeps.discounts[1], model.STRENGTHS[1]
    unknown = np.mean([sweeps.unknown(k) for k in range(model.BURN_IN + 1, model.SWEEPS + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            block = _Block(rows, offsets)
            m = len(block.ids)
            parent, tables = np.full(m, unknown), np.zeros(m)
            idx = np.argsort(block.ids, kind="stable")
            idx = idx[block.ids[idx] >= 0]
            told = sorted((r for r in rows if r["kind"] == "word"), key=lambda r: r["shard"])
            if told:
                parent[idx] = np.concatenate([unpack(r["x"], "<f4") for r in told])
                tables[idx] = np.concatenate([unpack(r["y"], "<f4") for r in told])
            context = block.context()
            p = ((s1 + d1 * tables) / (s1 + block.c))[context] * parent[block.word]
            good, at, keys, _ = block.pairs(n_buckets)
            told = sorted((r for r in rows if r["kind"] == "pair"), key=lambda r: r["bucket"])
            seated = np.concatenate([np.zeros(0, "<f4")] + [unpack(r["x"], "<f4") for r in told])
            if len(seated) != len(keys):
                raise RuntimeError("a block's pairs were not all answered")
            p[good] += seated[at] / (s1 + block.c[context[good]])
            del context, good, at, keys
            base = np.log10(block.c + 0.5) - below
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d["id"] for d in block.docs], id_type),
                    pa.array([d["train"] for d in block.docs], pa.bool_()),
                    pa.array(block.n_tokens),
                    pa.array(np.add.reduceat((block.c > 0).astype(np.int64)[block.word], block.starts)),
                    pa.array(np.add.reduceat(base[block.word], block.starts)),
                    pa.array(np.add.reduceat(np.log10(p), block.starts)),
                ],
                ["id", "train", "n_tokens", "known", "base", "score"],
            )

    return run


def _stats(df: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of the tasks' vectors of ``size`` numbers."""
    out = np.zeros(size, np.int64)
    for row in df.where("kind = 'stats'").select(column).collect():
        out += unpack(bytes(row[0]), "<i8")
    return out


def scores(own: DataFrame) -> tuple[DataFrame, int]:
    """(id, train, n_tokens, known, base, score) by document of (row, id, text, train); training tokens."""
    kind, id_type = own.schema["id"].dataType.simpleString(), to_arrow_type(own.schema["id"].dataType)
    listed = f"docs array<struct<id:{kind},train:boolean,n_tokens:bigint>>"
    # Row numbers and everything that hangs on them are written in one pass.
    posted = freeze(
        own.mapInArrow(releasing(_post(id_type)), f"block long, idx int, word binary, n long, body binary, {listed}"),
        "postings",
    )
    part = F.shiftrightunsigned(F.xxhash64("word"), 52).cast("int")
    words = posted.where("word IS NOT NULL").select("block", "idx", "word", "n")
    words = words.repartition(part).sortWithinPartitions(part, "word").withColumn("part", part)
    numbered = freeze(words.mapInArrow(releasing(_number()), _MESSAGE), "word-numbers")
    offsets = np.concatenate([[0], np.cumsum(_stats(numbered, "x", PARTS))])
    if offsets[-1] >= 1 << 32:
        raise ValueError("a word's number takes 32 bits")
    train_tokens, once, twice = _stats(numbered, "y", 3).tolist()
    bodies = posted.where("body IS NOT NULL").select("block", "body", "docs")
    size = F.aggregate("docs.n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    n_buckets = 1 + (bodies.agg(F.sum(size)).first()[0] or 0) // model.BLOCK_TOKENS
    blocks = bodies.unionByName(numbered.where("kind = 'words'"), allowMissingColumns=True)

    def dealt(df: DataFrame, column: str, run, schema: str = _MESSAGE) -> DataFrame:
        return df.repartition(column).sortWithinPartitions(column).mapInArrow(releasing(run), schema)

    asked = dealt(blocks, "block", _ask(offsets, n_buckets))
    merged = freeze(dealt(asked, "bucket", _merge()), "pairs")
    pairs_once, pairs_twice = _stats(merged, "x", 2).tolist()
    discounts = model._discount(once, twice), model._discount(pairs_once, pairs_twice)
    sweeps = Sweeps(int(offsets[-1]), discounts)
    repeated = merged.where("kind = 'repeated'")
    single, messages = merged.where("kind = 'single'"), merged.where("kind = 'tables'")
    questions, asks = merged.where("kind = 'question'").unionByName(repeated), merged.where("kind = 'ask'")
    for sweep in range(model.SWEEPS + 1):
        seated = freeze(dealt(single.unionByName(messages), "shard", _seat(sweeps, sweep)), "totals")
        tables, parent_tables = _stats(seated, "x", 2).tolist()
        sweeps.tables.append(tables)
        sweeps.parent_tables.append(parent_tables)
        if not sweep:
            single = seated.where("kind = 'single'")
        if sweep > model.BURN_IN:
            asks = asks.unionByName(seated.where(f"kind = 'sample{sweep}'"))
        if sweep < model.SWEEPS:
            drawn = repeated.unionByName(seated.where("kind = 'reply'"))
            drawn = freeze(dealt(drawn, "bucket", _draw(sweeps, sweep + 1)), "tables")
            messages = drawn.where("kind = 'tables'")
            if sweep + 1 > model.BURN_IN:
                questions = questions.unionByName(drawn.where("kind = 'seated'"))
    told = dealt(questions, "bucket", _tell_pairs(discounts[1])).unionByName(
        dealt(asks, "shard", _tell_words(sweeps))
    )
    found = dealt(
        blocks.unionByName(told, allowMissingColumns=True),
        "block",
        _add_up(sweeps, offsets, n_buckets, train_tokens, id_type),
        f"id {kind}, train boolean, n_tokens long, known long, base double, score double",
    )
    return found, train_tokens
