import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lanecast.llm import pitman_yor as P
from lanecast.llm import word_contexts as W

from . import edge


def test_every_word_is_a_context(spark):
    """600 equally frequent words tell the next one; 62 contexts leave most of that unused."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(500):
        firsts = rng.integers(0, 600, 40)
        rows.append((k, " ".join(f"a{i} b{i}" for i in firsts), "en", "a", 1, *edge.EXTRA))
    docs = spark.createDataFrame(rows, edge.DOCS).repartition(3)
    held = lambda found: [r for r in found.collect() if r["held_out"]]
    every = held(P.language_model_scores(docs, F.col("doc_id") % 5 != 1))
    some = held(P.language_model_scores(docs, F.col("doc_id") % 5 != 1, context_words=254))
    mean = lambda own: sum(r["score"] for r in own) / sum(r["n_tokens"] for r in own)
    # Half of the words are drawn from 600, the others follow: log10(600) / 2 = 1.39.
    assert mean(every) > -1.55
    assert mean(every) > mean(some) + 0.3


def model(rows, learn):
    """Predictive probability of (word, context), by the definition; numbers as in the operator."""
    texts = [(P.tokens(r[1]), learn(r)) for r in rows]
    total = Counter(w for text, own in texts if own for w in text)
    pairs = Counter(x for text, own in texts if own for x in zip([P.END] + text, text))
    rank = sorted(total, key=lambda w: (xxhash.xxh64_intdigest(w, 42) >> 52, w))
    number = {w: k for k, w in enumerate(rank)}
    seen, twos = Counter(total.values()), Counter(pairs.values())
    d0, d1 = P._discount(seen[1], seen[2]), P._discount(twos[1], twos[2])
    s0, s1 = P.STRENGTHS
    base = 1 / (len(total) + 1)
    listed = list(pairs)
    c = np.array([pairs[x] for x in listed])
    u, w = (np.array([number[x[k]] for x in listed]) for k in (0, 1))
    keys = (u.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)
    ids = np.arange(len(total))
    t, parent_t = np.ones(len(c), np.int64), np.ones(len(total), np.int64)
    samples = []
    for sweep in range(P.SWEEPS + 1):
        if sweep:
            t = P.sample_tables(c, (s1 + d1 * tables[u]) * parent[w], d1, W._mix(keys), 2 * sweep)  # noqa: F821
            weight = np.full(len(ids), (s0 + d0 * parent_t.sum()) * base)
            customers = np.bincount(w, t, len(ids)).astype(np.int64)
            parent_t = P.sample_tables(customers, weight, d0, W._mix(ids), 2 * sweep + 1)
        tables, customers = np.bincount(u, t, len(ids)), np.bincount(w, t, len(ids))
        spare = (s0 + d0 * parent_t.sum()) * base
        parent = (customers - d0 * parent_t + spare) / (s0 + t.sum())
        if sweep > P.BURN_IN:
            samples.append((t, tables, parent, spare / (s0 + t.sum())))
    t, tables, parent, unknown = (np.mean([s[k] for s in samples], axis=0) for k in range(4))
    seated = dict(zip(listed, c - d1 * t))

    def p(context, word):
        below = parent[number[word]] if word in number else unknown
        if context not in number:
            return below
        own = seated.get((context, word), 0.0) + (s1 + d1 * tables[number[context]]) * below
        return own / (s1 + total[context])

    return p, list(total), unknown


def corpus():
    rows = [(k, edge.prose(10 + 7 * (k % 9), k) + f" rare{k // 2}", "en", "a", 1, *edge.EXTRA) for k in range(60)]
    return rows + [(100, None, "en", "a", 0, *edge.EXTRA), (101, edge.prose(3000, 4), "en", "a", 0, *edge.EXTRA)]


def test_probabilities_sum_to_one():
    p, words, _ = model(corpus(), lambda r: r[0] % 5 != 1)
    for context in (*words[:20], P.END, b"unseen"):
        assert sum(p(context, w) for w in words) + p(context, b"unseen") == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("block, answers", [(None, None), (60, 7)])
def test_scores_equal_the_definition(spark, monkeypatch, block, answers):
    if block:  # many blocks and buckets
        monkeypatch.setattr(P, "BLOCK_TOKENS", block)
        monkeypatch.setattr(P, "PORTION_TOKENS", 20)
        monkeypatch.setattr(P, "HELD_ANSWERS", answers)
    rows = corpus()
    p, _, _ = model(rows, lambda r: r[0] % 5 != 1)
    docs = spark.createDataFrame(rows, edge.DOCS).repartition(3)
    for r in P.language_model_scores(docs, F.col("doc_id") % 5 != 1).collect():
        (text,) = [P.tokens(x[1]) for x in rows if x[0] == r["doc_id"]]
        want = sum(math.log10(p(u, w)) for u, w in zip([P.END] + text, text))
        assert r["score"] == pytest.approx(want, rel=1e-5), r["doc_id"]


def test_packed_values_come_back():
    for values in (np.zeros(0, "<i8"), np.array([3, 3, 900, 1 << 40], "<i8")):
        assert W.unpack(W.pack(values), "<i8").tolist() == values.tolist()
        assert W.unpack_sorted(W.pack_sorted(values)).tolist() == values.tolist()
    found = list(W._by_shard(np.array([1, W.SHARD_WORDS, W.SHARD_WORDS + 2]), np.array([7, 8, 9])))
    assert [(k, own.tolist(), v.tolist()) for k, own, v in found] == [(0, [1], [7]), (1, [0, 2], [8, 9])]
