"""Language-model scores by a hierarchical Pitman-Yor model.

Every context word has a restaurant; all share one parent, the unigram restaurant, whose
base is uniform over the vocabulary and one unknown word.  The context of a token is the
word before it: ``word_contexts`` has a restaurant for every word.  Below, on request, it is the
last of the ``context_words`` most frequent training words before it (or the start of the
text); then a few numbers per restaurant are all that tasks need to share.  Discounts are
estimated from counts of counts.

Seating is sampled by Gibbs sweeps in the Chinese-restaurant representation, collapsed to
the number of tables that serve a word in a restaurant: given the other words' tables the
chance of ``t`` tables for ``c`` customers is in proportion to S(c, t) * A^t, where S are the
generalised Stirling numbers and A is the weight of a new table, the parent's
probability of the word times (strength + discount * tables).  Up to 64 customers are
seated by that exactly, further ones in growing blocks by the restaurant's rule.  Words
are independent given the restaurants' table totals, so a sweep is one narrow pass over the
word table; totals of the sweep before are sums over all words.  Draws are hashes of
(word, context, sweep), so every pass repeats them and nothing but the totals is
kept.  Predictive probabilities are averaged over the sweeps after the first ones.

Data flow.  Texts are read into blocks.  A block gives one row for each distinct word, which
holds its counts and asks for its model in the contexts that occur, and one row with its
tokens as numbers of those words.  Counts are merged by word; the model is made by
word.  Questions meet their word's model in one join; the answers go back to their block,
where one task adds up every document.  A frequent word has a row per block, never one per
occurrence, tokens move once, and rows grow with documents and distinct words only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import freeze, importable, releasing

SWEEPS = 5
BURN_IN = 2
STRENGTHS = (1.0, 1.0)  # of the unigram and of the context restaurants
EXACT = 64  # customers seated exactly
BLOCK_TOKENS = 2_400_000
BLOCK_DOCS = 100_000
PORTION_TOKENS = 200_000  # held as words before they become numbers
HELD_WORDS = 1_000_000  # distinct words that a task counts together
CONTEXT_SHARE = 5_000  # a context word makes up one in so many tokens of some task
HELD_ANSWERS = 1_000_000  # answers, likewise
END = b""  # no word is empty

COUNT = np.dtype([("context", "u1"), ("n", "<u4")])


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), then one end."""
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(rows, tokens, train) of documents, of bounded size; a longer text is a portion itself.

    A row is what stands in the other columns.
    """
    rows, texts, train, total = [], [], [], 0
    for batch in batches:
        others = [c for c in batch.schema.names if c not in ("text", "train")]
        columns = [batch.column(c).to_pylist() for c in others]
        known = list(zip(*columns)) if columns else [()] * batch.num_rows
        text = batch.column("text")
        for k, (row, learn) in enumerate(zip(known, batch.column("train").to_pylist())):
            own = tokens(text[k].as_py())
            if rows and total + len(own) > PORTION_TOKENS:
                yield rows, texts, train
                rows, texts, train, total = [], [], [], 0
            rows.append(row)
            texts.append(own)
            train.append(bool(learn))
            total += len(own)
    if rows:
        yield rows, texts, train


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words that make up at least ``1 / CONTEXT_SHARE`` of a task's training tokens.

    Only the most frequent words of all are wanted; rarer ones needn't move.
    """
    counts, total = Counter(), 0

    def passed_on():
        often = {w: n for w, n in counts.items() if n * CONTEXT_SHARE >= total}
        return pa.RecordBatch.from_arrays(
            [pa.array(list(often), pa.binary()), pa.array(list(often.values()), pa.int64())], ["word", "n"]
        )

    for _, texts, train in _portions(batches):
        for own, learn in zip(texts, train):
            if learn:
                counts.update(own)
                total += len(own)
        if len(counts) > HELD_WORDS:
            yield passed_on()
            counts.clear()
            total = 0
    yield passed_on()


def contexts(ids: np.ndarray, number_of: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Per token, the number of the last context word before it in its text; 0 if there is none.

    ``starts`` are the texts' first tokens.
    """
    own = number_of[ids]
    at = np.where(own > 0, np.arange(len(ids)), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]])
    first = 0
    if starts is not None:
        sizes = np.diff(np.append(starts, len(ids)))
        first = np.repeat(starts, sizes)
    return np.where(last >= first, own[last], 0).astype(np.int64)


def _grouped(order_key: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A binary array of ``n`` slices of ``values``, whose keys ascend."""
    bounds = np.searchsorted(order_key, np.arange(n + 1)) * values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(values.tobytes())]
    )


def _numbers(n_words: int, n_contexts: int) -> np.ndarray:
    """Context number by a block's word number: the context words come first in every block."""
    out = np.zeros(max(n_words, n_contexts), np.int64)
    out[: n_contexts - 1] = np.arange(1, n_contexts)
    return out


_POSTED = "block long, idx int, word binary, contexts binary, counts binary, body binary"


def _post(context_words: list[bytes], id_type: pa.DataType):
    """Rows of two kinds: a block's distinct words with contexts and counts, its documents and tokens."""
    document = pa.struct([("id", id_type), ("train", pa.bool_()), ("n_tokens", pa.int64())])
    kinds = {
        "block": pa.int64(), "idx": pa.int32(), "word": pa.binary(), "contexts": pa.binary(),
        "counts": pa.binary(), "body": pa.binary(), "docs": pa.list_(document),
    }

    def rows_of(n: int, **columns) -> pa.RecordBatch:
        arrays = [columns[c] if c in columns else pa.nulls(n, k) for c, k in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, list(kinds))

    n_contexts = len(context_words) + 1

    def block_of(ids: dict[bytes, int], rows: list, texts: list[np.ndarray], train: list[bool]):
        sizes = np.array([len(t) for t in texts])
        word = np.concatenate(texts)
        starts = np.cumsum(sizes) - sizes
        context = contexts(word, _numbers(len(ids), n_contexts), starts)
        key, at = np.unique((word.astype(np.int64) << 8) | context, return_inverse=True)
        n = np.bincount(at[np.repeat(np.array(train), sizes)], minlength=len(key))
        del context, at
        words, first = list(ids), rows[0][0]  # a block is named by its first row
        used, of_key = np.unique(key >> 8, return_inverse=True)
        learned = np.flatnonzero(n)
        counts = np.empty(len(learned), COUNT)
        counts["context"], counts["n"] = key[learned] & 0xFF, n[learned]
        yield rows_of(
            len(used),
            block=pa.array(np.full(len(used), first)),
            idx=pa.array(used.astype(np.int32)),
            word=pa.array([words[k] for k in used.tolist()], pa.binary()),
            contexts=_grouped(of_key, (key & 0xFF).astype(np.uint8), len(used)),
            counts=_grouped(of_key[learned], counts, len(used)),
        )
        listed = [
            {"id": i, "train": learn, "n_tokens": int(n)} for (_, i), learn, n in zip(rows, train, sizes)
        ]
        yield rows_of(
            1,
            block=pa.array([first]),
            body=pa.array([zstandard.compress(word.astype("<u4").tobytes(), 1)], pa.binary()),
            docs=pa.array([listed], pa.list_(document)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened():
            return {w: k for k, w in enumerate(context_words)}, [], [], [], 0

        ids, rows, texts, train, total = opened()
        for more, words, learn in _portions(batches):
            n = sum(map(len, words))
            if rows and (total + n > BLOCK_TOKENS or len(rows) + len(more) > BLOCK_DOCS):
                yield from block_of(ids, rows, texts, train)
                ids, rows, texts, train, total = opened()
            add = ids.setdefault
            texts += [np.fromiter((add(w, len(ids)) for w in t), np.int32, len(t)) for t in words]
            rows += more
            train += learn
            total += n
        if rows:
            yield from block_of(ids, rows, texts, train)

    return run


def _runs(words: pa.Array) -> np.ndarray:
    """Number of the run of equal words of each row."""
    if len(words) < 2:
        return np.zeros(len(words), np.int64)
    change = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1))
    return np.concatenate([[0], np.cumsum(change.to_numpy(zero_copy_only=False))])


def _payload(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(entries, row of each) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    sizes = np.diff(offsets) // kind.itemsize
    return flat.view(kind), np.repeat(np.arange(len(column)), sizes)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of sorted rows by word; a word may go on in the next batch."""
    held: tuple | None = None

    def batch_of(words, key, n):
        counts = np.empty(len(key), COUNT)
        counts["context"], counts["n"] = key & 0xFF, n
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), _grouped(key >> 8, counts, len(words))], ["word", "counts"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("word")
        run = _runs(words)
        entries, row = _payload(batch.column("counts"), COUNT)
        key = (run[row] << 8) | entries["context"]
        n = entries["n"].astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        named = words.take(pa.array(first)).to_pylist()
        if held is not None:
            if held[0] == named[0]:
                key, n = np.concatenate([held[1], key]), np.concatenate([held[2], n])
            else:
                yield batch_of([held[0]], held[1], held[2])
        key, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, n, len(key)).astype(np.int64)
        last = len(named) - 1
        open_ = key >> 8 == last
        held = (named[last], key[open_] & 0xFF, n[open_])
        if last:
            yield batch_of(named[:last], key[~open_], n[~open_])
    if held is not None:
        yield batch_of([held[0]], held[1], held[2])


@cache
def _stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c, t up to ``EXACT``: ways to seat c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        for t in range(1, c + 1):
            out[c + 1, t] = np.logaddexp(out[c + 1, t], out[c, t] + np.log(c - discount * t))
            out[c + 1, t + 1] = np.logaddexp(out[c + 1, t + 1], out[c, t])
    return out


def _uniform(seeds: np.ndarray, number: int) -> np.ndarray:
    h = seeds.astype(np.uint64) + np.uint64((number * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def sample_tables(c: np.ndarray, new: np.ndarray, discount: float, seeds: np.ndarray, number: int):
    """Tables of ``c`` customers each, where a new table weighs ``new``."""
    t = np.ones(len(c), dtype=np.int64)
    stirling = _stirling(round(discount, 6))
    draw = np.zeros(len(c))
    some = np.flatnonzero(c > 1)
    draw[some] = _uniform(seeds[some], number * 1000)
    log_new = np.log(np.maximum(new, 1e-300))
    seated = np.minimum(c, EXACT)
    by_size = some[np.argsort(seated[some], kind="stable")]
    cuts = np.searchsorted(seated[by_size], np.arange(2, EXACT + 2))
    for size in range(2, EXACT + 1):
        own = by_size[cuts[size - 2] : cuts[size - 1]]
        for a in range(0, len(own), 1 << 16):
            part = own[a : a + (1 << 16)]
            logs = stirling[size, 1 : size + 1] + log_new[part, None] * np.arange(1, size + 1)
            logs -= logs.max(axis=1, keepdims=True)
            sums = np.cumsum(np.exp(logs), axis=1)
            t[part] = 1 + (sums < draw[part, None] * sums[:, -1:]).sum(axis=1)
    rest = np.flatnonzero(c > EXACT)
    at = np.full(len(rest), EXACT, dtype=np.int64)
    step = 1
    while len(rest):
        block = np.minimum(np.maximum(1, at // 16), c[rest] - at)
        p = new[rest] / (new[rest] + at - discount * t[rest])
        # The number of new tables in a block, by a rounded normal draw for its binomial.
        u, v = _uniform(seeds[rest], number * 1000 + 2 * step), _uniform(seeds[rest], number * 1000 + 2 * step + 1)
        z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        mean = block * p
        few = mean < 5
        fresh = np.where(few, 0, np.rint(mean + z * np.sqrt(mean * (1 - p))))
        k = np.flatnonzero(few)
        if len(k):  # few expected: invert the Poisson distribution
            left, chance, n = u[k].copy(), np.exp(-mean[k]), np.zeros(len(k))
            for j in range(1, 40):
                more = left > chance
                n += more
                left = np.where(more, left - chance, 0.0)
                chance = chance * mean[k] / j
            fresh[k] = n
        t[rest] += np.clip(fresh, 0, block).astype(np.int64)
        at = at + block
        going = at < c[rest]
        rest, at = rest[going], at[going]
        step += 1
    return t


@dataclass
class Totals:
    """What the restaurants share: by context customers and, per sweep, tables."""

    n_contexts: int
    vocabulary: int = 0
    train_tokens: int = 0
    discounts: tuple[float, float] = (0.5, 0.5)
    customers: np.ndarray | None = None
    tables: list[np.ndarray] = field(default_factory=list)  # by sweep, by context
    parent_tables: list[int] = field(default_factory=list)

    @property
    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)


def _seeds(words: pa.Array) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 7) for w in words.to_pylist()), np.uint64, len(words))


def chain(words: pa.Array, counts: pa.Array, totals: Totals, sweeps: int):
    """Run ``sweeps`` sweeps for a batch of words.

    Yields for each sweep (word of each entry, contexts, customers, tables, the words'
    parent customers and tables, the parent's probability of the words).
    """
    entries, row = _payload(counts, COUNT)
    context, c = entries["context"].astype(np.int64), entries["n"].astype(np.int64)
    m = len(words)
    word_seeds = _seeds(words)
    seeds = word_seeds[row] ^ (context.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    d0, d1 = totals.discounts
    s0, s1 = STRENGTHS
    t = np.ones(len(c), dtype=np.int64)
    parent_t = np.ones(m, dtype=np.int64)
    for sweep in range(sweeps + 1):
        if sweep:
            tables, all_parent = totals.tables[sweep - 1], totals.parent_tables[sweep - 1]
            parent_c = np.bincount(row, t, m)
            p = parent_c - d0 * parent_t + (s0 + d0 * all_parent) * totals.base
            p /= s0 + tables.sum()
            t = sample_tables(c, (s1 + d1 * tables[context]) * p[row], d1, seeds, 2 * sweep)
            parent_c = np.bincount(row, t, m).astype(np.int64)
            weight = np.full(m, (s0 + d0 * all_parent) * totals.base)
            parent_t = sample_tables(parent_c, weight, d0, word_seeds, 2 * sweep + 1)
        yield sweep, row, context, c, t, np.bincount(row, t, m), parent_t


def _larger(batches: Iterator[pa.RecordBatch], words: int = 150_000) -> Iterator[pa.RecordBatch]:
    """Batches put together, as a sweep's cost is mostly by batch; none without words."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= words:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _totals(totals: Totals, sweep: int):
    """One row per task: tables by context and in the parent after a sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parent = np.zeros(totals.n_contexts, np.int64), 0
        for batch in _larger(batches):
            *_, last = chain(batch.column("word"), batch.column("counts"), totals, sweep)
            _, _, context, _, t, _, parent_t = last
            tables += np.bincount(context, t, totals.n_contexts).astype(np.int64)
            parent += int(parent_t.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(totals.n_contexts + 1)), pa.array(np.append(tables, parent))],
            ["context", "n"],
        )

    return run


def _statistics(n_contexts: int):
    """Customers by context, then (words, tokens, words and entries seen once and twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n_contexts + 6, np.int64)
        for batch in batches:
            entries, row = _payload(batch.column("counts"), COUNT)
            n = entries["n"].astype(np.int64)
            of_word = np.bincount(row, n, batch.num_rows)
            found[:n_contexts] += np.bincount(entries["context"], n, n_contexts).astype(np.int64)
            found[n_contexts:] += [
                batch.num_rows,
                n.sum(),
                (of_word == 1).sum(),
                (of_word == 2).sum(),
                (n == 1).sum(),
                (n == 2).sum(),
            ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(found))), pa.array(found)], ["context", "n"]
        )

    return run


def _summed(df: DataFrame, run, size: int) -> np.ndarray:
    """A vector of fixed size, summed over all tasks."""
    rows = df.mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in rows.collect():
        out[row["context"]] = row["n"]
    return out


def _discount(once: int, twice: int) -> float:
    return round(float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95)), 6)


def _predict(totals: Totals):
    """By word: count, log10 probability in the contexts that hold it, parent's by sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d0, d1 = totals.discounts
        s0, s1 = STRENGTHS
        samples = range(BURN_IN + 1, SWEEPS + 1)
        for batch in _larger(batches):
            m = batch.num_rows
            parents, sums = [], 0.0
            for sweep, row, context, c, t, parent_c, parent_t in chain(
                batch.column("word"), batch.column("counts"), totals, SWEEPS
            ):
                if sweep not in samples:
                    continue
                tables, all_parent = totals.tables[sweep], totals.parent_tables[sweep]
                p = parent_c - d0 * parent_t + (s0 + d0 * all_parent) * totals.base
                p /= s0 + tables.sum()
                own = c - d1 * t + (s1 + d1 * tables[context]) * p[row]
                sums = sums + own / (s1 + totals.customers[context]) / len(samples)
                parents.append(p)
            model = np.empty(len(c), MODEL)
            model["context"], model["log"] = context, np.log10(sums)
            flat = np.stack(parents, axis=1).astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"),
                    pa.array(np.bincount(row, c, m).astype(np.int64)),
                    _grouped(row, model, m),
                    _grouped(np.repeat(np.arange(m), flat.shape[1]), flat.reshape(-1), m),
                ],
                ["model_word", "c", "model", "parents"],
            )

    return run


MODEL = np.dtype([("context", "u1"), ("log", "<f4")])


_ANSWERS = "block long, idx binary, c binary, sizes binary, logs binary"


def _answer(totals: Totals):
    """For each block and task, the asked words' counts and log10 probabilities by context."""
    d0, d1 = totals.discounts
    s0, s1 = STRENGTHS
    samples = list(range(BURN_IN + 1, SWEEPS + 1))
    # What a context gives to the parent's probability, by sample.
    share = np.array([(s1 + d1 * totals.tables[k]) / (s1 + totals.customers) for k in samples])
    nobody = np.array(
        [(s0 + d0 * totals.parent_tables[k]) * totals.base / (s0 + totals.tables[k].sum()) for k in samples]
    )

    def answered(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        asked, row = _payload(batch.column("contexts"), np.dtype("u1"))
        context = asked.astype(np.int64)
        parents = np.tile(nobody, (batch.num_rows, 1))
        flat, of = _payload(batch.column("parents").fill_null(b""), np.dtype("<f4"))
        some = np.unique(of)
        parents[some] = flat.reshape(len(some), len(samples))
        log = np.log10((share[:, context].T * parents[row]).mean(axis=1))
        # Where the context holds the word its own probability counts.
        entries, owner = _payload(batch.column("model").fill_null(b""), MODEL)
        keys = (owner << 8) | entries["context"]
        if len(keys):
            wanted = (row << 8) | context
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            log[hit] = entries["log"][at[hit]]
        c = batch.column("c").fill_null(0).to_numpy()
        sizes = np.bincount(row, minlength=batch.num_rows)
        return batch.column("block").to_numpy(), batch.column("idx").to_numpy(), c, sizes, log

    def passed_on(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block, idx, c, sizes, log = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(block, kind="stable")
        log = log[np.argsort(np.repeat(block, sizes), kind="stable")]
        block, sizes = block[order], sizes[order]
        names, number = np.unique(block, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(names)]
            + [
                pa.array([zstandard.compress(x.as_py(), 1) for x in column], pa.binary())
                for column in (
                    _grouped(number, idx[order].astype("<i4"), len(names)),
                    _grouped(number, c[order].astype("<i8"), len(names)),
                    _grouped(number, sizes.astype("u1"), len(names)),
                    _grouped(np.repeat(number, sizes), log.astype("<f4"), len(names)),
                )
            ],
            ["block", "idx", "c", "sizes", "logs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(answered(batch))
                n += batch.num_rows
            if n > HELD_ANSWERS:
                yield passed_on(held)
                held, n = [], 0
        if held:
            yield passed_on(held)

    return run


def _add_up(totals: Totals, id_type: pa.DataType):
    """Every document of a block, from its tokens and the answers to its words (rows sorted by block)."""
    below = np.log10(totals.train_tokens + 0.5 * (totals.vocabulary + 1))

    def documents(body: bytes, docs: pa.StructScalar, answers: list[dict]) -> pa.RecordBatch:
        word = np.frombuffer(zstandard.decompress(body), "<u4")
        n_tokens = docs.field("n_tokens").to_numpy()
        starts = np.cumsum(n_tokens) - n_tokens
        idx, c, sizes, log = (
            np.concatenate([np.frombuffer(zstandard.decompress(a[name]), kind) for a in answers])
            for name, kind in (("idx", "<i4"), ("c", "<i8"), ("sizes", "u1"), ("logs", "<f4"))
        )
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        order = np.argsort(idx)
        sizes = sizes[order].astype(np.int64)
        # Answers in the order of (word, context), as the distinct pairs below.
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        log = log[np.repeat(first[order], sizes) + inner].astype(np.float64)
        key = contexts(word, _numbers(int(word.max()) + 1, totals.n_contexts), starts)
        key |= word.astype(np.int64) << 8
        pairs, at = np.unique(key, return_inverse=True)
        del key
        if len(pairs) != len(log):
            raise RuntimeError("a block's words were not all answered")
        score = np.add.reduceat(log[at], starts)
        del pairs, at
        of_word, base_of_word = np.zeros(int(word.max()) + 1, np.int64), np.zeros(int(word.max()) + 1)
        of_word[idx] = c > 0
        base_of_word[idx] = np.log10(c + 0.5) - below
        return pa.RecordBatch.from_arrays(
            [
                docs.field("id"),
                docs.field("train"),
                docs.field("n_tokens"),
                pa.array(np.add.reduceat(of_word[word], starts)),
                pa.array(np.add.reduceat(base_of_word[word], starts)),
                pa.array(score),
            ],
            ["id", "train", "n_tokens", "known", "base", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, body, docs, answers = None, None, None, []
        for batch in batches:
            columns = {c: batch.column(c) for c in ("body", "idx", "c", "sizes", "logs")}
            for k, name in enumerate(batch.column("block").to_pylist()):
                if name != block:
                    if body is not None:
                        yield documents(body, docs, answers)
                    block, body, docs, answers = name, None, None, []
                if columns["body"][k].is_valid:
                    body, docs = columns["body"][k].as_py(), batch.column("docs")[k].values
                else:
                    answers.append({c: columns[c][k].as_py() for c in ("idx", "c", "sizes", "logs")})
        if body is not None:
            yield documents(body, docs, answers)

    return run


def _frequent_contexts(own: DataFrame, context_words: int) -> tuple[DataFrame, int]:
    """Scores with the last of the ``context_words`` most frequent words as context; training tokens."""
    kind = own.schema["id"].dataType.simpleString()
    counted = own.select("text", "train").mapInArrow(releasing(_count), "word binary, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.where(F.length("word") > 0).orderBy(F.col("n").desc(), "word").limit(context_words)
    frequent = [bytes(r["word"]) for r in top.collect()]
    totals = Totals(len(frequent) + 1)
    # Row numbers and everything that hangs on them are written in one pass.
    id_type = to_arrow_type(own.schema["id"].dataType)
    listed = f"docs array<struct<id:{kind},train:boolean,n_tokens:bigint>>"
    posted = freeze(own.mapInArrow(releasing(_post(frequent, id_type)), f"{_POSTED}, {listed}"), "postings")
    counts = posted.where(F.length("counts") > 0).select("word", "counts")
    merged = counts.repartition("word").sortWithinPartitions("word").mapInArrow(
        _merge, "word binary, counts binary"
    )
    words = freeze(merged, "word-counts")
    found = _summed(words, _statistics(totals.n_contexts), totals.n_contexts + 6)
    totals.customers = found[: totals.n_contexts].astype(np.float64)
    totals.vocabulary, totals.train_tokens = int(found[-6]), int(found[-5])
    totals.discounts = _discount(found[-4], found[-3]), _discount(found[-2], found[-1])
    for sweep in range(SWEEPS + 1):
        sums = _summed(words, _totals(totals, sweep), totals.n_contexts + 1)
        totals.tables.append(sums[:-1].astype(np.float64))
        totals.parent_tables.append(int(sums[-1]))
    model = words.mapInArrow(
        releasing(_predict(totals)), "model_word binary, c long, model binary, parents binary"
    )
    # A sort-merge join at every size; partitions of words with many rows are split.
    asked = posted.where("contexts IS NOT NULL").select("block", "idx", "word", "contexts")
    met = asked.join(model.hint("merge"), F.col("word") == F.col("model_word"), "left")
    answers = met.select("block", "idx", "contexts", "c", "model", "parents").mapInArrow(
        releasing(_answer(totals)), _ANSWERS
    )
    bodies = posted.where("body IS NOT NULL").select("block", "body", "docs")
    together = answers.unionByName(bodies, allowMissingColumns=True)
    scored = together.repartition("block").sortWithinPartitions("block").mapInArrow(
        releasing(_add_up(totals, id_type)),
        f"id {kind}, train boolean, n_tokens long, known long, base double, score double",
    )
    return scored, totals.train_tokens


def language_model_scores(
    docs: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    context_words: int | None = None,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``train`` tells which documents are learned from (null: not).  ``base_score`` is the
    add-one-half unigram's and ``score`` the model's log10 probability of the text, end
    included; ``perplexity`` is the model's per token.  A null or empty text is the end
    alone.  Null and repeated ids are scored row by row.  Without training documents
    every word is unknown, and both models give each token their uniform base.  No rows
    give none.

    The context of a token is the word before it, whatever the size of the vocabulary.  With
    ``context_words`` it is the last of so many most frequent words instead.
    """
    if context_words is not None and not 0 <= context_words < 255:
        raise ValueError("a context's number takes eight bits")
    importable(docs.sparkSession)
    own = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        F.col(text_column).cast("string").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    if context_words is None:
        from .word_contexts import scores  # it needs this module

        scored, train_tokens = scores(own)
    else:
        scored, train_tokens = _frequent_contexts(own, context_words)
    return scored.select(
        F.col("id").alias(id_column),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
