import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecast.llm import pitman_yor as P

from . import edge


def slow(rows, held):
    """Counts and base scores by the definition."""
    texts = [(r[1] or "").encode().lower().split() + [P.END] for r in rows]
    c = Counter(w for t, r in zip(texts, rows) if not held(r) for w in t)
    n, v = sum(c.values()), len(c)
    out = []
    for r, t in zip(rows, texts):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((str(r[0]), held(r), len(t), sum(c[w] > 0 for w in t), n, round(base, 6)))
    return sorted(out)


def shown(found):
    return sorted(
        (str(r[0]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
        for r in found
    )


def test_edge_rows(spark, monkeypatch):
    rows = edge.rows()
    held = lambda r: r[0] is None or r[0] in (5, 8)
    train = F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(5, 8)
    whole = P.language_model_scores(edge.docs(spark), train).collect()
    assert shown(whole) == slow(rows, held)
    assert all(r["score"] < 0 and r["perplexity"] >= 1 for r in whole)
    # Small blocks and early sums give the same scores.
    monkeypatch.setattr(P, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(P, "PORTION_TOKENS", 20)
    monkeypatch.setattr(P, "HELD_WORDS", 3)
    monkeypatch.setattr(P, "HELD_ANSWERS", 2)
    again = P.language_model_scores(edge.docs(spark), train).collect()
    key = lambda r: (str(r[0]), round(r["score"], 3))
    assert sorted(map(key, again)) == sorted(map(key, whole))


def test_null_train_is_held_out_and_no_training_is_uniform(spark):
    found = P.language_model_scores(edge.docs(spark), F.lit(None).cast("boolean")).collect()
    assert {r["held_out"] for r in found} == {True} and {r["n_known"] for r in found} == {0}
    assert all(abs(r["score"]) < 1e-6 for r in found)  # one unknown word is all there is


def test_no_rows(spark):
    assert P.language_model_scores(edge.none(spark), F.lit(True)).collect() == []


@pytest.fixture(scope="module")
def model():
    """Word counts by context, with totals after all sweeps, made without Spark."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    counts = {}
    for w in range(300):
        for f in rng.choice(5, int(rng.integers(1, 5)), replace=False):
            counts[w, int(f)] = 1 + int(rng.pareto(1.1))
    counts[0, 0] = 20000
    words = pa.array([b"w%d" % w for w in range(300)], pa.binary())
    payload = []
    for w in range(300):
        own = sorted((f, c) for (x, f), c in counts.items() if x == w)
        payload.append(np.array(own, dtype=P.COUNT).tobytes())
    payload = pa.array(payload, pa.binary())
    totals = P.Totals(5, 300, sum(counts.values()), (0.6, 0.7))
    totals.customers = np.array([sum(c for (_, f), c in counts.items() if f == k) for k in range(5)], float)
    for sweep in range(P.SWEEPS + 1):
        *_, last = P.chain(words, payload, totals, sweep)
        _, row, context, c, t, parent_c, parent_t = last
        totals.tables.append(np.bincount(context, t, 5))
        totals.parent_tables.append(int(parent_t.sum()))
        assert (t >= 1).all() and (t <= c).all()
        assert (parent_t >= 1).all() and (parent_t <= parent_c).all()
    return words, payload, totals


def test_predictive_probabilities_sum_to_one(model):
    words, payload, totals = model
    d0, d1 = totals.discounts
    s0, s1 = P.STRENGTHS
    for sweep, row, context, c, t, parent_c, parent_t in P.chain(words, payload, totals, P.SWEEPS):
        if sweep <= P.BURN_IN:
            continue
        tables, all_parent = totals.tables[sweep], totals.parent_tables[sweep]
        parent = (parent_c - d0 * parent_t + (s0 + d0 * all_parent) * totals.base) / (s0 + tables.sum())
        unknown = (s0 + d0 * all_parent) * totals.base / (s0 + tables.sum())
        assert abs(parent.sum() + unknown - 1) < 1e-9
        for f in range(5):
            p = (s1 + d1 * tables[f]) * parent
            np.add.at(p, row[context == f], (c - d1 * t)[context == f])
            total = p.sum() + (s1 + d1 * tables[f]) * unknown
            assert abs(total / (s1 + totals.customers[f]) - 1) < 1e-9


def test_tables_follow_the_chinese_restaurant():
    """Table counts against the exact conditional distribution, and large ones against seating."""
    d, new = 0.5, 0.8
    seeds = np.arange(40000, dtype=np.uint64) * np.uint64(7919)
    for c in (2, 5, 12):
        logs = P._stirling(d)[c, 1 : c + 1] + np.log(new) * np.arange(1, c + 1)
        want = np.exp(logs - logs.max())
        want /= want.sum()
        t = P.sample_tables(np.full(40000, c), np.full(40000, new), d, seeds, 1)
        got = np.bincount(t, minlength=c + 1)[1:] / len(t)
        assert np.abs(got - want).max() < 0.01
    # Beyond the exact size: mean number of tables when customers are seated one by one.
    rng = np.random.default_rng(5)
    exact = P.sample_tables(np.full(2000, P.EXACT), np.full(2000, 5.0), d, seeds[:2000], 3)
    t = exact.copy()
    for n in range(P.EXACT, 1000):
        t += rng.random(2000) < 5.0 / (5.0 + n - d * t)
    fast = P.sample_tables(np.full(2000, 1000), np.full(2000, 5.0), d, seeds[:2000], 3)
    assert abs(fast.mean() - t.mean()) < 0.03 * t.mean()


def test_contexts_are_the_last_frequent_word():
    number_of = np.array([1, 2, 0, 0])
    assert P.contexts(np.array([2, 0, 3, 3, 1, 0, 2]), number_of).tolist() == [0, 0, 1, 1, 1, 2, 1]


def test_contexts_end_with_their_text():
    number_of = np.array([1, 2, 0, 0])
    found = P.contexts(np.array([2, 0, 3, 3, 1, 0, 2]), number_of, np.array([0, 3, 6]))
    assert found.tolist() == [0, 0, 1, 0, 0, 2, 0]


def test_scores_equal_a_model_made_and_applied_without_spark(spark):
    """Every document's score, token by token from the definition of the predictive probability."""
    import pyarrow as pa

    rows = [(k, edge.prose(10 + 7 * (k % 9), k) + f" rare{k // 2}", "en", "a", 1, *edge.EXTRA) for k in range(60)]
    rows += [(100, None, "en", "a", 0, *edge.EXTRA), (101, edge.prose(3000, 4), "en", "a", 0, *edge.EXTRA)]
    learn = lambda r: r[0] % 5 != 1
    found = P.language_model_scores(
        spark.createDataFrame(rows, edge.DOCS).repartition(3), F.col("doc_id") % 5 != 1, context_words=4
    ).collect()
    texts = {r[0]: P.tokens(r[1]) for r in rows}
    total = Counter(w for r in rows if learn(r) for w in texts[r[0]])
    frequent = sorted((w for w in total if w), key=lambda w: (-total[w], w))[:4]

    def in_context(text):
        last = 0
        for w in text:
            yield w, last
            last = frequent.index(w) + 1 if w in frequent else last

    counts = Counter(x for r in rows if learn(r) for x in in_context(texts[r[0]]))
    vocabulary = sorted(total)
    payload = [
        np.array(sorted((f, c) for (x, f), c in counts.items() if x == w), dtype=P.COUNT).tobytes() for w in vocabulary
    ]
    words, payload = pa.array(vocabulary, pa.binary()), pa.array(payload, pa.binary())
    seen, entries = Counter(total.values()), Counter(counts.values())
    discounts = P._discount(seen[1], seen[2]), P._discount(entries[1], entries[2])
    totals = P.Totals(5, len(vocabulary), sum(total.values()), discounts)
    totals.customers = np.array([sum(c for (_, f), c in counts.items() if f == k) for k in range(5)], float)
    p = Counter()
    d0, d1 = discounts
    s0, s1 = P.STRENGTHS
    samples = P.SWEEPS - P.BURN_IN
    for sweep in range(P.SWEEPS + 1):
        *_, (_, row, context, c, t, parent_c, parent_t) = P.chain(words, payload, totals, sweep)
        totals.tables.append(np.bincount(context, t, 5).astype(float))
        totals.parent_tables.append(int(parent_t.sum()))
        if sweep <= P.BURN_IN:
            continue
        tables = totals.tables[sweep]
        spare = (s0 + d0 * totals.parent_tables[sweep]) * totals.base
        seated = {(vocabulary[w], int(f)): n - d1 * k for w, f, n, k in zip(row, context, c, t)}
        parent = dict(zip(vocabulary, (parent_c - d0 * parent_t + spare) / (s0 + tables.sum())))
        for w in {w for text in texts.values() for w in text}:
            for f in range(5):
                below = parent.get(w, spare / (s0 + tables.sum()))
                own = seated.get((w, f), 0.0) + (s1 + d1 * tables[f]) * below
                p[w, f] += own / (s1 + totals.customers[f]) / samples
    for r in found:
        want = sum(math.log10(p[x]) for x in in_context(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(want, rel=1e-5), r["doc_id"]


def test_better_than_the_base_on_held_out_texts(spark):
    """Words depend on the frequent word before them."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(400):
        lang = k % 2
        words = []
        for _ in range(60):
            words.append(f"{'ab'[lang]}{int(rng.zipf(1.4)) % 5000}")
            if rng.random() < 0.4:
                words.append(("the", "le")[lang])
        rows.append((k, " ".join(words), "en", "a", 1, *edge.EXTRA))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    found = P.language_model_scores(spark.createDataFrame(rows, edge.DOCS), fold).collect()
    assert shown(found) == slow(rows, lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 1)
    own = [r for r in found if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in own) / sum(r["n_tokens"] for r in own) > 0.1
