import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanecast.llm import queries
from lanecast.llm import spelling as S

from . import edge


def slow_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = slow_counts(rows)
    near = {w: [o for o in n if abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: o if n[o] >= 10 * n[w] else None for w, o in best.items()}
    out = []
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return sorted(out)


def answer(docs, **other):
    found = S.spelling_variants(docs, **other).collect()
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found)


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "w", 5, 3) for r in rows], "doc_id long, text string, word string, n long, key long"
    ).repartition(5)


def random_rows(n, seed):
    """Few stems with one or two random edits, so that chains of forms and anagrams arise."""
    rng = random.Random(seed)
    stems = ["lantern", "harbour", "meadows", "ärgerlich", "Überflüge", "aabbccdd", "abcdefgh", "banana", "élèverait"]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(0, 40)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice("abeÀÿ")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[1:] + w[:1]])
            words.append(w)
        rows.append((k if rng.random() < 0.9 else None, rng.choice([" ", "-", "œ", "1 ", "×× ", "—"]).join(words)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return random_rows(600, 3) + [(1, None), (2, ""), (3, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999)]


def test_equals_brute_force(spark, rows):
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want), "a chain of forms"
    assert answer(frame(spark, rows)) == want


@pytest.mark.parametrize("parts", [3, 8, 13, 16])
def test_the_number_of_parts_changes_nothing(spark, rows, parts):
    own = rows[:150]
    assert answer(frame(spark, own), parts=parts) == brute(own)


def test_hot_signature_in_blocks(spark, rows, monkeypatch):
    from functools import partial

    monkeypatch.setattr(S, "shared_keys", partial(S.shared_keys, block_rows=3))
    own = rows[:200]
    assert answer(frame(spark, own), parts=3) == brute(own)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in edge.rows()]
    assert answer(edge.docs(spark)) == brute(rows)
    assert answer(edge.none(spark)) == []


LETTER = st.sampled_from("abcÀÿ")
WORD = st.text(LETTER, min_size=7, max_size=10)
EDITS = st.lists(st.tuples(st.integers(0, 9), LETTER, st.integers(0, 2), st.integers(0, 20)), max_size=20)


def edited(words, edits):
    words = sorted(words)
    for at, letter, kind, which in edits:
        w = words[which % len(words)]
        at %= len(w)
        new = w[:at] + ("" if kind == 2 else letter) + w[at + (kind > 0) :]
        if len(new) >= 7:
            words.append(new)
    return set(words)


@settings(max_examples=300, deadline=None)
@given(st.builds(edited, st.sets(WORD, min_size=2, max_size=8), EDITS), st.integers(3, 9))
def test_pairs_one_edit_apart_meet_once(words, parts):
    """Over all signatures a near pair is accepted exactly once, any other pair never."""
    words = sorted(words)
    packed = S.Words(words)
    keys = packed.signatures(parts)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words)), indexing="ij"))
    i, j = i[i < j], j[i < j]
    times = np.zeros(len(i), int)
    for number in range(keys.shape[1]):
        met = keys[i, number] == keys[j, number]
        check = S.Verifier(packed, np.full(len(words), number), parts)
        times += met & check.maybe(i, j) & check.near(i, j)
    assert times.tolist() == [int(one_edit(words[a], words[b])) for a, b in zip(i, j)]


def test_runs_are_the_contracts():
    for text in ["", "Ab cÀÿ×÷œd", "a¿bÀ", "x—y\U0001f600z é", "日本a語", "İI", "a_b1c"]:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        assert [r.decode() for r in S.runs(text.encode())] == re.findall("[A-Za-zÀ-ÿ]+", low)


def test_tasks_that_pass_on_early_lose_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "HELD_WORDS", 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": ["1", "2", "1"], "text": [b"lanterns harbours meadows"] * 3})
    parts = list(S._count_words(iter([batch])))
    assert len(parts) == 4 and sum(sum(p["n"].to_pylist()) for p in parts) >= 7


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(queries.SQL["op11_spelling_variants"])
    found = queries.op11_spelling_variants(spark, folder)
    assert found.columns == want.columns
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want.fetchall()))
