import numpy as np
import pytest
import xxhash

from lanecast.llm import simhash as S

from . import edge


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """(id, fingerprint) rows to least reachable ids, by comparing all pairs."""
    comp = list(range(len(rows)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bin(rows[a][1] ^ rows[b][1]).count("1") <= 4:
                comp[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(rows))]


def test_fingerprint_follows_the_definition():
    for _, text, *_ in edge.rows():
        if text is None or len(text) < 5000:
            assert S.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_every_word_is_within_three_flips_of_its_codeword():
    sample = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    table = S.codewords()
    assert np.bincount(table, minlength=4096).tolist() == [2048] * 4096
    near = S.fuzzy_keys(sample, 23)
    counts = np.bincount(near[0])
    assert set(counts.tolist()) <= {1, 6}


def test_pairs_within_four_bits_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    flips = [rng.choice(64, rng.integers(0, 5), replace=False) for _ in a]
    b = np.array([x ^ np.uint64(sum(1 << int(f) for f in own)) for x, own in zip(a, flips)], np.uint64)

    def keys(values):
        found = [set() for _ in values]
        for key, row in S.keys_of(values.view(np.int64)):
            for k, r in zip(key.tolist(), row.tolist()):
                found[r].add(k)
        return found

    assert all(x & y for x, y in zip(keys(a), keys(b)))


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = edge.rows()
    for k in range(150):  # near copies: a word changed in a long text
        words = edge.prose(300, k % 30).split()
        words[int(rng.integers(300))] = "changed"
        rows.append((100 + k, " ".join(words), "en", "a", 1, *edge.EXTRA))
    found = S.simhash_components(spark.createDataFrame(rows, edge.DOCS)).collect()
    prints = [(r[0], slow_fingerprint(r[1]) if len(r[1] or "") < 9000 else S.fingerprint(r[1]) & (1 << 64) - 1) for r in rows]
    want = sorted(
        ((i, f"{f:016x}", c) for (i, f), c in zip(prints, slow_components(prints))), key=str
    )
    assert sorted(map(tuple, found), key=str) == want


def test_hot_group_is_split_into_blocks(spark, monkeypatch):
    """A chain of fingerprints in one hot key stays one component across blocks."""
    from lanecast.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    monkeypatch.setattr(blocks.shared_keys, "__defaults__", (8,))
    values = [0]
    for k in range(60):
        values.append(values[-1] ^ (0b111 << (k % 21) * 3))
    values = sorted(set(values))
    links = S.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    from lanecast.llm.components import connected_components

    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    ids = [(k, v) for k, v in enumerate(values)]
    want = slow_components(ids)
    groups = {}
    for k, c in enumerate(want):
        groups.setdefault(c, []).append(values[k])
    for own in groups.values():
        assert len({roots.get(v, v) for v in own}) == 1


def test_no_rows(spark):
    assert S.simhash_components(edge.none(spark)).collect() == []


def test_wider_distances_are_refused(spark):
    with pytest.raises(ValueError):
        S.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), 5)
