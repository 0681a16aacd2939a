import numpy as np
import pytest

from lanecast.llm import embeddings as E

VECTORS = "vec_id long, embedding array<float>, label int, v long, key string, n_links string"


def slow(rows, threshold=0.98):
    ok = [
        lab is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)
        for _, v, lab, *_ in rows
    ]
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if k else None for k, (_, v, *_) in zip(ok, rows)]
    n = len(rows)
    link = [[False] * n for _ in rows]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
                link[a][b] = link[b][a] = bool(unit[a] @ unit[b] >= threshold)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b, l in enumerate(link[todo.pop()]):
                if l and b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], sum(link[a]), min(ids) if ids else None))
    return out


def check(spark, rows):
    found = E.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want = [(i, n, c, i is not None and i == c) for i, n, c in slow(rows)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_hadamard_is_orthogonal():
    h = E.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))
    x = np.random.default_rng(0).standard_normal((5, 12))
    assert np.allclose(np.linalg.norm(E.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_edge_rows(spark):
    x = (1, "k", "q")
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0, 2.0], 1), (2, [1.0, -0.0, 2.0], 1), (2, [1.0, 0.0, 2.0], 1), (3, [2.0, 0.01, 4.0], 1),
        (4, [1.0, 0.0, 2.0], 2), (5, [1.0, 0.0, 2.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1),
        (9, [1.0, None, 2.0], 1), (10, [1.0, nan, 2.0], 1), (11, [inf, 0.0, 2.0], 1), (None, [1.0, 0.0, 2.0], 1),
        (None, [5.0, 1.0, 0.0], 3), (12, [3.0], 1), (13, [7.0], 1), (14, [-3.0], 1), (15, [1e-30, 0.0, 2e-30], 1),
        (16, [1.0, 0.0], 1),
    ]
    check(spark, [r + x for r in rows])


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(40):
        centre = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 9))):
            away = rng.standard_normal(64)
            v = centre + away * rng.uniform(0, 0.25) * np.linalg.norm(centre) / np.linalg.norm(away)
            rows.append((len(rows), v.astype(np.float32).tolist(), g % 3, 1, "k", "q"))
    check(spark, rows)


def test_hot_group_in_blocks(spark, monkeypatch):
    """A third of the rows near each other, in blocks of a few: counts stay exact."""
    import lanecast.llm.blocks as blocks

    own = blocks.shared_keys
    monkeypatch.setattr(E, "shared_keys", lambda keyed, n: own(keyed, 10))
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(k, (centre + 0.02 * rng.standard_normal(16)).tolist(), 1, 1, "k", "q") for k in range(80)]
    rows += [(100 + k, rng.standard_normal(16).tolist(), 1, 1, "k", "q") for k in range(100)]
    check(spark, rows)


def test_recall_at_the_threshold():
    plan = E.plan_for(64, 100_000)
    rng = np.random.default_rng(99)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * away
    a, b = E.keys(x, plan), E.keys(y, plan)
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= 0.99


@pytest.mark.parametrize("threshold,recall", [(0.9, 0.999), (0.8, 0.99)])
def test_recall_at_lower_thresholds(threshold, recall):
    plan = E.plan_for(64, 10**6, threshold, recall)
    assert plan.tables <= E.LAST_TABLES
    rng = np.random.default_rng(98)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(1 - threshold**2) * away
    a, b = E.keys(x, plan), E.keys(y, plan)
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= recall - 0.02


def test_an_unreachable_recall_is_an_error(monkeypatch):
    monkeypatch.setattr(E, "LAST_TABLES", 4)
    with pytest.raises(ValueError, match="miss the recall"):
        E.plan_for(64, 10**6, 0.02)


def test_no_rows(spark):
    assert E.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
