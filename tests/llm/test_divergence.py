import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lanecast.llm import divergence as D
from lanecast.llm import queries

from . import edge

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def found_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return TERM.findall(low)


def brute(rows, min_docs=10, top=10):
    """The contract word for word, on (text, lang, source) rows."""
    docs = [(lang or "", source or "", found_terms(text)) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        frequency = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in frequency.items() if n >= min_docs]
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, source, terms in own:
            count[source].update(t for t in terms if frequency[t] >= min_docs)
        everywhere = sum(count.values(), Counter())

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: shares(c) for s, c in count.items()}
        q = shares(everywhere)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


def answer(docs, **other):
    return sorted(tuple(r) for r in D.source_divergence(docs, **other).collect())


def random_rows(n, seed, sources=6):
    rng = random.Random(seed)
    words = [*(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), "Ärger", "été", "語", "x y"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None, "rare"] if rng.random() < 0.9 else ["only"])
        source = rng.choice([f"s{k}" for k in range(sources)] + [None, ""])
        text = rng.choice([" ", ", ", "-7 "]).join(
            rng.choice(words[: 40 + 30 * len(source or "")]).upper() if rng.random() < 0.2 else rng.choice(words)
            for _ in range(rng.randrange(0, 60))
        )
        rows.append((text if rng.random() < 0.95 else None, lang, source))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, *r, 7, "x") for k, r in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n long, term string",
    ).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return random_rows(900, 1) + [("the only term", "lonely", "a"), (None, "lonely", "b")]


def test_equals_brute_force(spark, rows):
    assert answer(frame(spark, rows)) == brute(rows)


def test_many_shards_chunks_flushes_and_tiles_change_nothing(spark, rows, monkeypatch):
    """Bounds this small reach the workers as well, which fork after they are set."""
    monkeypatch.setattr(D, "SHARD_KEYS", 7)
    monkeypatch.setattr(D, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(D, "SOURCE_BLOCK", 2)
    assert answer(frame(spark, rows)) == brute(rows)


def test_tasks_that_pass_on_early_lose_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD_TERMS", 5)
    texts = [b"a b c d e f g", b"A b", b"h i j k"] * 50
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y", "x"] * 50, "text": texts})
    found = Counter()
    parts = list(D._document_counts(iter([batch])))
    assert len(parts) > 2
    for part in parts:
        for r in part.to_pylist():
            found[r["lang"], r["term"]] += r["n"]
    assert found[("x", b"a")] == 50 and found[("y", b"a")] == 50 and found[("x", b"k")] == 50


def test_hot_group_and_repeated_rows(spark):
    rows = [("same words here again and Again", "en", "hot")] * 400
    rows += [(f"same words {'there' if k % 2 else 'here'} ß", "en", f"s{k % 9}") for k in range(200)]
    assert answer(frame(spark, rows)) == brute(rows)


def test_edge_rows(spark):
    rows = [(r[1], r[2], r[3]) for r in edge.rows()]
    assert answer(edge.docs(spark), min_docs=2) == brute(rows, 2)
    assert answer(edge.docs(spark)) == brute(rows)
    assert answer(edge.none(spark)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 30000])
def test_perfect_hash_is_minimal_and_verified(n):
    keys = [b"key%d" % k for k in range(n)]
    seed, displacements, slots = D.perfect_hash(keys)
    assert len(displacements) == n and sorted(slots.tolist()) == list(range(n))
    by_slot = [keys[k] for k in np.argsort(slots)]
    row = {
        "seed": seed, "n": n, "base": 0, "displacements": displacements.tobytes(),
        "lengths": np.array([len(k) for k in by_slot], "<i4").tobytes(), "terms": b"".join(by_slot),
    }
    shard = D.Shard(row, 0)
    asked = keys + [b"other%d" % k for k in range(500)]
    places = shard.find(asked, D.hashes(asked, D.SHARD_SEED))
    assert (places[n:] == -1).all() and (places[:n] == slots).all()


def test_another_seed_is_taken_when_hashes_meet(monkeypatch):
    true = D.hashes
    monkeypatch.setattr(D, "hashes", lambda k, s: np.ones(len(k), np.uint64) if s == D.SHARD_SEED else true(k, s))
    seed, _, slots = D.perfect_hash([b"a", b"b", b"c"])
    assert seed == D.SHARD_SEED + 1 and sorted(slots.tolist()) == [0, 1, 2]


def test_shares_are_exact_beyond_32_bits():
    counts = np.array([0, 5, 10**12, 4 * 10**14])
    total = int(counts.sum())
    want = [1 + 10**9 * (int(c) + 2) // (total + 8) for c in counts]
    assert D.shares(counts, total, 4).tolist() == want


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(queries.SQL["op13_source_divergence"])
    found = queries.op13_source_divergence(spark, folder)
    assert found.columns == want.columns
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
