import random

import numpy as np

from lanecast.llm import decontamination as D

from . import edge

ITEMS = "item_id long, text string, doc_id long"


def slow_distance(item, text):
    """Least edit distance of the item to any passage, by the textbook table."""
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(999)}"
        elif kind == 1:
            words.insert(at, f"new{rng.randrange(999)}")
        else:
            del words[at]
    return words


def made(seed=0, n_items=30, n_docs=200):
    rng = random.Random(seed)
    word = lambda: rng.choice(edge.WORDS) if rng.random() < 0.5 else f"w{rng.randrange(3000)}"
    items = [(k, [word() for _ in range(rng.randint(6, 60))]) for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        text = [word() for _ in range(rng.randint(0, 200))]
        if k % 2:
            item = items[k % n_items][1]
            most = D.allowed_edits(len(item))
            at = rng.randint(0, len(text))
            text[at:at] = edited(rng, item, rng.choice([0, most // 2, most, most + 4]))
        docs.append((k, text))
    return items, docs


def test_distance_equals_the_textbook():
    rng = random.Random(1)
    chunk = D.Chunk([(0, "a b c d e f g h")])
    for _ in range(200):
        item = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        code = lambda s: D.np.array([ord(x) for x in s], dtype=D.np.int32)
        cost, begin, end = D.banded_distances(code(item), code(text))
        assert cost == slow_distance(item, text)
        assert slow_distance(item, text[begin:end]) == cost
    assert chunk.keys == [0]


def test_matches_are_exact_and_recall_is_reached():
    items, docs = made()
    chunk = D.Chunk([(k, " ".join(w)) for k, w in items])
    hits = {(h[0], h[1]): h[2] for h in chunk.matches([" ".join(t) for _, t in docs])}
    want = {}
    for d, text in docs:
        for k, item in items:
            cost = slow_distance(item, text)
            if cost <= D.allowed_edits(len(item)):
                want[d, k] = cost
    assert all(hits[p] >= want[p] for p in hits) and set(hits) <= set(want)
    assert all(p in hits for p, cost in want.items() if cost == 0)
    assert len(hits) >= 0.95 * len(want)


def far(n, count=40):
    """Items of n words and, for each, a text that holds it with as many edits as are allowed."""
    rng = random.Random(n)
    items = [[f"w{rng.randrange(3000)}" for _ in range(n)] for _ in range(count)]
    around = lambda: [f"w{rng.randrange(3000)}" for _ in range(30)]
    texts = [around() + edited(rng, x, D.allowed_edits(n)) + around() for x in items]
    return [(k, " ".join(x)) for k, x in enumerate(items)], [" ".join(t) for t in texts]


def test_recall_at_the_largest_distance_at_every_length():
    for n in (20, 60, 61, 100, 200, 400, 700):
        items, texts = far(n)
        hits = D.Chunk(items).matches(texts)
        found = {h[0] for h in hits if h[0] == h[1]}
        assert len(found) >= 0.95 * len(items), n
        assert all(h[3] == n and h[2] <= D.allowed_edits(n) for h in hits)


def test_groups_whose_tables_miss_the_recall_are_searched_without(monkeypatch):
    monkeypatch.setattr(D, "MOST_TABLES", 1)
    for n in (40, 150):
        items, texts = far(n, 10)
        chunk = D.Chunk(items)
        assert [g.tables for g in chunk.groups] == [None] * len(chunk.groups)
        assert [(h[0], h[1]) for h in chunk.matches(texts)] == [(k, k) for k in range(10)]


def test_passages_are_found_whatever_surrounds_them():
    items, _ = made(3, 8, 0)
    items += [(k, edge.prose(n, k).split()) for k, n in ((8, 61), (9, 300))]
    chunk = D.Chunk([(k, " ".join(w)) for k, w in items])
    for k, words in items:
        shown = " ".join(w.title() + "," for w in words)
        texts = [shown, "zz " * 500 + shown, shown + " zz" * 500, "q\n" + shown + "*** end"]
        assert [(h[0], h[1], h[2]) for h in chunk.matches(texts)] == [(t, k, 0) for t in range(4)]


def test_edge_rows(spark, monkeypatch):
    rows = [(1, edge.prose(30, 9), 5), (2, None, 5), (3, "", 5), (4, "one", 5), (None, edge.prose(40, 3), 5),
            (1, edge.prose(30, 9), 5), (6, "***", None)]
    items = spark.createDataFrame(rows, ITEMS)
    found = {tuple(r)[:3] for r in D.contaminated(edge.docs(spark), items).collect()}
    assert {(6, 4, 0), (7, 1, 0), (8, None, 0)} <= found
    assert not {r[0] for r in found} & {3, 4, 5}
    # In chunks of one item each the result is the same.
    monkeypatch.setattr(D, "CHUNK_BYTES", 1)
    assert {tuple(r)[:3] for r in D.contaminated(edge.docs(spark), items).collect()} == found


def test_no_rows(spark):
    items = spark.createDataFrame([(1, edge.prose(30), 1)], ITEMS)
    assert D.contaminated(edge.none(spark), items).collect() == []
    assert D.contaminated(edge.docs(spark), spark.createDataFrame([], ITEMS)).collect() == []


def test_short_items_are_found_inside_texts():
    items = [(1, "alpha beta gamma delta"), (2, "gamma, DELTA"), (3, "alpha"), (4, "gamma delta"), (5, edge.prose(30, 2))]
    texts = [
        "so Alpha beta gamma-delta it is, gamma delta", "alpha beta gamma", "Alpha!", "gamma", "x delta",
        "alpha beta x gamma delta", edge.prose(30, 2), "gamma", "delta",
    ]
    hits = sorted(D.Chunk(items).matches(texts))
    want = [
        (0, 1, 0, 4, 1, 5), (0, 2, 0, 2, 3, 5), (0, 4, 0, 2, 3, 5), (2, 3, 0, 1, 0, 1),
        (5, 2, 0, 2, 3, 5), (5, 4, 0, 2, 3, 5), (6, 5, 0, 30, 0, 30),
    ]
    assert hits == want
    assert sorted(D.Chunk(items[:4]).matches(texts)) == want[:-1]
    # No passage crosses from one text to the next.
    assert D.Chunk([(1, "gamma delta")]).matches(["gamma", "delta"]) == []


def test_short_items_equal_brute_force():
    rng = random.Random(4)
    items = [(k, [rng.choice("abcd") for _ in range(rng.randint(2, 4))]) for k in range(30)]
    texts = [[rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(60)]
    want = set()
    for t, text in enumerate(texts):
        for k, item in items:
            places = [a for a in range(len(text) - len(item) + 1) if text[a : a + len(item)] == item]
            if places:
                want.add((t, k, 0, len(item), places[0], places[0] + len(item)))
    found = D.Chunk([(k, " ".join(x)) for k, x in items]).matches([" ".join(x) for x in texts])
    assert set(found) == want and len(found) == len(want)


def test_scripts_without_spaces():
    assert D.split_words("Größe 12, 東京タワー abc東1") == ["größe", "12", "東", "京", "タ", "ワ", "ー", "abc", "東", "1"]
    assert D.split_words("a_b ฿ \u30fb") == ["a", "b"]
    item = "光合成は植物が光を使って糖を作る反応である"
    texts = ["前置き。" + item + "。それから", "前置き" + item.replace("糖", "塩") + "です", "植物と光", "before " + item]
    hits = {(h[0], h[2]) for h in D.Chunk([(7, item)]).matches(texts)}
    assert {(0, 0), (1, 1), (3, 0)} == hits
    assert [h[:3] for h in D.Chunk([(7, "東京駅")]).matches(["ここは東京駅です", "京東駅"])] == [(0, 7, 0)]


def test_walks_of_few_and_many_windows_follow_the_bits():
    """Windows beyond the number of symbols take another way to the same places."""
    rng = np.random.default_rng(2)
    words = rng.integers(D.OTHER, 30, 400)
    words[-60:] = D.END
    bits = D.random_bits(30, 70)[3]

    def definition(start, position):
        at = start
        for step in range(position):
            at += (int(bits[step >> 6][words[at]]) >> (step & 63)) & 1
        return words[at]

    for starts in (np.arange(0, 300, 17), np.arange(300)):
        walk = D.Walk(words, starts, bits)
        for position in (3, 50, 67):
            assert walk.symbols(position).tolist() == [definition(s, position) for s in starts.tolist()]


def test_latin_texts_are_cut_as_bytes_to_the_same_words():
    every = "".join(map(chr, range(256)))
    texts = [every, " ".join(every), "x".join(every), "Größe_12 ÀÉÿ ª²¼µ", "", "a\x85b\xa0c\x1cd", edge.prose(50)]
    for text in texts:
        assert [w.decode("latin-1") for w in D.latin_words(text)] == D.split_words(text)
    assert D.latin_words("Σ a") is None
    chunk = D.Chunk([(1, "Größe der ÿ Äpfel naïve Σ words")])
    for text in ("GRÖSSE größe ÿ Σ naïve", "größe ÿ naïve other", "größe ÿ\u3000naïve"):
        assert chunk.symbols(text).tolist() == [chunk.ids.get(w, D.OTHER) for w in D.split_words(text)]


def test_tables_share_their_steps(monkeypatch):
    """All tables of a walk and a first position go on from each other's second position."""
    items = [(k, edge.prose(40, k)) for k in range(30)]
    chunk = D.Chunk(items)
    texts = [edge.prose(200, 100 + k) + " " + items[k % 30][1] for k in range(40)]
    steps, symbols = [0], D.Walk.symbols

    def counted(walk, position):
        steps[0] += (position - walk.step) * len(walk.at)
        return symbols(walk, position)

    flat, begins = D.joined([chunk.symbols(t) for t in texts])
    starts = [np.arange(len(flat) - 60)] * len(chunk.groups)
    monkeypatch.setattr(D.Walk, "symbols", counted)
    found = np.unique(np.concatenate([f for f in chunk.candidates(flat, starts) if len(f)]), axis=0).tolist()
    shared, alone = steps[0], 0
    for group in chunk.groups:
        assert group.tables
        for table in group.tables:
            walk = D.Walk(flat.astype(np.intp), starts[0], chunk.bits[table.walk])
            taken = [symbols(walk, p) for p in table.positions]
            first = table.first[taken[0]].sum()
            alone += first * (table.positions[1] - table.positions[0])
            h = D._mix(taken)
            low, high = (np.searchsorted(table.hashes, h, side) for side in ("left", "right"))
            for start in np.flatnonzero(high > low).tolist():
                for item in table.items[low[start] : high[start]].tolist():
                    assert [start, item] in found
    firsts = sum(max(t.positions[0] for g in chunk.groups for t in g.tables if t.walk == w) for w in range(D.WALKS))
    assert shared - firsts * len(starts[0]) < alone
