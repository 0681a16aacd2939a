import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecast.llm import toxicity as T

from . import edge

SMALL = T.Settings(window=16, stride=8, word_rows=512, gram_rows=1024, hidden=5, attention=4, steps=160, batch=48)
MARKS = ["vilebrat", "vilescum", "viledolt", "vilefool"]


def corpus(n, seed):
    """Texts of common words; every third holds marked words, some in forms not seen before."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for k in range(n):
        words = rng.choice(edge.WORDS, int(rng.integers(8, 120))).tolist()
        toxic = k % 3 == 0
        if toxic:
            for at in range(0, len(words), 10):
                words[at] = MARKS[int(rng.integers(4))] + "abcdefgh"[int(rng.integers(8))] * (seed > 1)
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return T.train(*corpus(400, 1), (1.0, 1.0), SMALL)


def test_gradients_follow_finite_differences():
    s = T.Settings(window=5, word_rows=16, gram_rows=16, word_size=3, gram_size=3, hidden=3, attention=3)
    texts = ["ab cd ef", "gh ij kl mn op", "ab kl"]
    v = T._Trainable(s)
    docs = [v.index(T.split_words(t)) for t in texts]
    v.rows()
    v.shown = np.ones(len(v.word), np.float32)
    windows, _ = T._index_windows(docs, s)
    labels = np.array([1.0, 0.0, 1.0], np.float32)
    w = {k: x.astype(np.float64) for k, x in T._initial(s).items()}
    _, g, _, _ = T._backward(w, s, v, windows, labels)
    rng = np.random.default_rng(0)
    for name, grad in g.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in w[name].shape)
            old = w[name][at]
            w[name][at] = old + 1e-2
            up = T._backward(w, s, v, windows, labels)[0]
            w[name][at] = old - 1e-2
            down = T._backward(w, s, v, windows, labels)[0]
            w[name][at] = old
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-3 + 0.02 * abs(grad[at]), name


def test_held_out_accuracy_also_on_unseen_forms(model):
    texts, labels = corpus(200, 2)
    assert ((T.score_texts(texts, model) >= 0.5) == labels).mean() > 0.9


def test_windows_cover_all_words():
    for n in (0, 1, 16, 17, 24, 25, 1000):
        starts = T.windows_of(n, SMALL)
        seen = {k for s in starts for k in range(s, min(n, s + SMALL.window))}
        assert seen == set(range(n))
        assert all(b - a <= SMALL.stride for a, b in zip(starts, starts[1:]))


def test_a_score_does_not_depend_on_the_other_texts(model):
    texts = corpus(40, 3)[0] + ["", None, "x", edge.prose(5000)]
    together = T.score_texts(texts, model)
    alone = np.concatenate([T.score_texts([t], model) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert ((together >= 0) & (together <= 1)).all()


def test_edge_rows(spark, model):
    found = edge.docs(spark).select("doc_id", "text", T.toxicity(F.col("text"), model, spark).alias("s"))
    found = found.collect()
    assert len(found) == len(edge.rows())
    bare = [r["s"] for r in found if not (r["text"] or "").strip()]
    assert len(bare) == 4 and {round(b, 9) for b in bare} == {round(model.prior, 9)}
    assert edge.none(spark).select(T.toxicity(F.col("text"), model, spark)).collect() == []


LABELS = "doc_id long, quality int, toxic int, text string"


def test_sample_is_bounded_and_skips_held_out_rows(spark):
    texts, labels = corpus(90, 1)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string")
    rows = [(k, 1, int(c), "x") for k, c in enumerate(labels)]
    rows += [(None, 1, 1, "x"), (3, 1, None, "x"), (4, 1, 1, "x")]  # 4 is labelled both ways
    known = spark.createDataFrame(rows, LABELS)
    s = T.Settings(docs_per_class=20)
    rows, rates = T.labelled_sample(docs, known, F.col("doc_id") >= 10, s)
    found, own = zip(*[(r["t"], r["toxic"]) for r in rows.collect()])
    own = np.array(own)
    assert [int((own == c).sum()) for c in (0, 1)] == [20, 20]
    assert not set(found) & set(texts[:10])
    assert abs(rates[0] - 20 / 54) < 0.02


def test_one_class_or_no_labels_give_the_prior(spark):
    docs = edge.docs(spark)
    nothing = T.fit(docs, spark.createDataFrame([], LABELS), s=SMALL)
    assert nothing.weights is None and T.score_texts(["a", ""], nothing).tolist() == [0.0, 0.0]
    clean = T.fit(docs, spark.createDataFrame([(1, 1, 0, "x"), (7, 1, 0, "x")], LABELS), s=SMALL)
    assert T.score_texts(["a"], clean).tolist() == [0.0]
    empty = T.fit(edge.none(spark), spark.createDataFrame([(1, 1, 0, "x")], LABELS), s=SMALL)
    assert empty.weights is None


def test_windows_are_drawn_over_the_whole_text():
    words = [f"w{k}" for k in range(5000)]
    s = T.Settings(windows_per_doc=20)
    drawn = T.drawn_windows(" ".join(words), s)
    begins = [int(d[0][1:]) for d in drawn]
    assert len(drawn) == 20 and all(len(d) == s.window for d in drawn)
    assert min(begins) < 1500 and max(begins) > 3500
    assert T.drawn_windows(" ".join(words), s) == drawn
    assert T.drawn_windows("", s) == [] and T.drawn_windows(None, s) == []
    assert T.drawn_windows("a b", s) == [["a", "b"]]


def test_training_in_tasks_equals_training_in_one_process(spark):
    texts, labels = corpus(120, 1)
    texts += ["", edge.prose(3000)]
    labels = np.append(labels, [0, 1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(k, 1, int(c), "x") for k, c in enumerate(labels)], LABELS)
    found = T.fit(docs, known, s=SMALL)
    order = sorted(range(len(texts)), key=lambda k: (zlib.crc32(str(k).encode()), k))
    own = T.train([texts[k] for k in order], labels[order], (1.0, 1.0), SMALL)
    assert np.allclose(T.score_texts(texts, found), T.score_texts(texts, own), atol=1e-6)


def test_forward_pass_equals_the_definition():
    """Word by word and in double precision: gates, states, attention, logit."""
    s = T.Settings(window=6, word_rows=16, gram_rows=16, word_size=3, gram_size=3, hidden=3, attention=3)
    v = T.Vocabulary(s)
    docs = [v.index(T.split_words(t)) for t in ("ab cd ef gh", "ij", "ab ef ij kl mn op")]
    v.rows()
    windows, _ = T._index_windows(docs, s)
    w = T._initial(s)
    x = v.inputs(w)

    def sigmoid(a):
        return 1 / (1 + np.exp(-a))

    def states(ids, way):
        state, out = np.zeros(s.hidden), {}
        for t in range(len(ids)) if way == "f" else reversed(range(len(ids))):
            g = x[ids[t]].astype(float) @ w["x" + way] + w["c" + way]
            r = state @ w["h" + way]
            z, reset = sigmoid(g[:3] + r[:3]), sigmoid(g[3:6] + r[3:6])
            state = (1 - z) * np.tanh(g[6:] + reset * r[6:]) + z * state
            out[t] = state
        return out

    for ids, logit in zip(docs, T.window_logits(windows, x, w)):
        f, b = states(ids, "f"), states(ids, "b")
        both = np.array([np.concatenate([f[t], b[t]]) for t in range(len(ids))])
        e = np.exp(np.tanh(both @ w["attend"] + w["attend_c"]) @ w["query"])
        assert abs((e / e.sum()) @ both @ w["out"] + w["out_c"][0] - logit) < 1e-5
