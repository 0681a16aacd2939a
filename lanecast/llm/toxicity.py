"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as two vectors: one of its own (hashed), and the mean of its
character n-grams' (hashed, with word ends marked), so an unseen inflection of a known
insult still looks like it.  A forward and a backward GRU read a window of words;
attention weighs the words' states, and the weighted state gives the window's logit.
A document's windows overlap and cover the whole text; a logistic function of their
logits (mean, highest, share above zero) gives its score.

The network is trained on the driver, by Adam with a fixed number of steps, on windows
drawn over the whole texts of a bounded sample of labelled documents.  Tasks draw those
windows, and later read other sampled documents whole for the logistic function, so no
whole text reaches the driver.  Executors get the weights (about a megabyte, fixed) and score
documents independently: a narrow step without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from .tables import freeze, importable, release_memory, releasing

WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """Sizes of the network, its windows and its training; all fixed for every table size."""

    window: int = 64
    stride: int = 32
    word_rows: int = 1 << 14
    word_size: int = 8
    gram_rows: int = 1 << 14
    gram_size: int = 12
    grams: tuple[int, ...] = (3, 4, 5)
    hidden: int = 10
    attention: int = 10
    docs_per_class: int = 1500  # the bound of the training sample
    windows_per_doc: int = 64  # of a training document, drawn over its whole text
    steps: int = 700
    batch: int = 160
    rate: float = 0.01
    word_dropout: float = 0.3
    seed: int = 5


@dataclass
class Model:
    settings: Settings
    weights: dict[str, np.ndarray] | None  # none if the sample lacks a class
    doc_weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    prior: float = 0.0


def split_words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def word_rows(words: list[str], rows: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % rows for w in words), np.int64, len(words))


def gram_rows(words: list[str], sizes: tuple[int, ...], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of all character n-grams of ``<word>``, hashed together for all words."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    joined = "<" + "><".join(words) + ">"
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    found, at = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        at.append(owner[: len(h)][inside])
        found.append((h[inside] % np.uint64(rows)).astype(np.int32))
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    return at[order], found[order]


class Vocabulary:
    """The distinct words of a portion of texts, with their input rows; row 0 is padding."""

    def __init__(self, s: Settings):
        self.s, self.ids, self.words = s, {}, []

    def index(self, words: list[str]) -> np.ndarray:
        get, ids = self.ids.get, self.ids
        out = np.empty(len(words), dtype=np.int32)
        for k, w in enumerate(words):
            i = get(w)
            if i is None:
                i = ids[w] = len(ids) + 1
                self.words.append(w)
            out[k] = i
        return out

    def rows(self) -> None:
        self.word = np.concatenate([[0], word_rows(self.words, self.s.word_rows)])
        at, self.gram = gram_rows(self.words, self.s.grams, self.s.gram_rows)
        self.gram_word = at + 1
        self.count = np.bincount(self.gram_word, minlength=len(self.words) + 1)
        self.count = np.maximum(self.count, 1).astype(np.float32)

    def inputs(self, w: dict[str, np.ndarray]) -> np.ndarray:
        """[distinct, word_size + gram_size]: a word's own vector beside its n-grams' mean."""
        own = w["word"][self.word]
        grams = np.empty((len(self.word), w["gram"].shape[1]), dtype=np.float32)
        for d in range(grams.shape[1]):
            sums = np.bincount(self.gram_word, w["gram"][self.gram, d], len(self.word))
            grams[:, d] = sums / self.count
        x = np.concatenate([own, grams], axis=1)
        x[0] = 0
        return x


def windows_of(n_words: int, s: Settings) -> list[int]:
    """Starts of overlapping windows that cover all words."""
    if n_words <= s.window:
        return [0]
    starts = list(range(0, n_words - s.window, s.stride))
    return [*starts, n_words - s.window]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _initial(s: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    d, h, a = s.word_size + s.gram_size, s.hidden, s.attention

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = {
        "word": normal(s.word_rows, s.word_size, scale=0.1),
        "gram": normal(s.gram_rows, s.gram_size, scale=0.3),
    }
    for way in "fb":
        w["x" + way] = normal(d, 3 * h, scale=d**-0.5)
        w["h" + way] = normal(h, 3 * h, scale=h**-0.5)
        w["c" + way] = np.zeros(3 * h, np.float32)
        w["c" + way][:h] = 1.0  # keep the state at first
    w["attend"] = normal(2 * h, a, scale=(2 * h) ** -0.5)
    w["attend_c"] = np.zeros(a, np.float32)
    w["query"] = normal(a, scale=a**-0.5)
    w["out"] = normal(2 * h, scale=(2 * h) ** -0.5)
    w["out_c"] = np.zeros(1, np.float32)
    return w


def _states(gates: np.ndarray, index: np.ndarray, hidden: np.ndarray, back: bool, keep: list | None):
    """States of one direction, [time, window, hidden].  A padding word's gate keeps the state."""
    steps, h = index.shape[1], hidden.shape[0]
    state = np.zeros((len(index), h), np.float32)
    out = np.empty((steps, len(index), h), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x = gates[index[:, t]]
        r = state @ hidden
        zr = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
        z, reset = zr[:, :h], zr[:, h:]
        n = np.tanh(x[:, 2 * h :] + reset * r[:, 2 * h :])
        new = n + z * (state - n)
        if keep is not None:
            keep.append((t, z, reset, n, r[:, 2 * h :], state))
        state = out[t] = new
    return out


def _gates(x: np.ndarray, w: dict[str, np.ndarray], way: str, h: int) -> np.ndarray:
    g = x @ w["x" + way] + w["c" + way]
    g[0, :h] = 60.0  # padding leaves the state as it is
    return g


def _attend(states: np.ndarray, pad: np.ndarray, w: dict[str, np.ndarray]):
    """Attention over the words of each window; states [time, window, 2 * hidden]."""
    u = np.tanh(states @ w["attend"] + w["attend_c"])
    e = u @ w["query"]
    e[pad] = -1e9
    e -= e.max(axis=0)
    np.exp(e, out=e)
    e /= e.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", e, states)
    return u, e, pooled, pooled @ w["out"] + w["out_c"][0]


def window_logits(index: np.ndarray, x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    h = w["hf"].shape[0]
    out = np.empty(len(index), np.float32)
    gates = {way: _gates(x, w, way, h) for way in "fb"}
    for a in range(0, len(index), 2048):
        part = index[a : a + 2048]
        states = np.concatenate(
            [_states(gates[way], part, w["h" + way], way == "b", None) for way in "fb"], axis=2
        )
        out[a : a + 2048] = _attend(states, part.T == 0, w)[3]
    return out


def _backward(w, s: Settings, vocabulary: Vocabulary, index, labels):
    """Loss and gradients of one batch."""
    h = s.hidden
    used, local = np.unique(index, return_inverse=True)
    if used[0] != 0:
        used, local = np.concatenate([[0], used]), local + 1
    local = local.reshape(index.shape)
    x = vocabulary.inputs_of(w, used)
    keeps: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate(
        [
            _states(_gates(x, w, way, h), local, w["h" + way], way == "b", keeps[way])
            for way in "fb"
        ],
        axis=2,
    )
    pad = index.T == 0
    u, e, pooled, logit = _attend(states, pad, w)
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = -np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9))
    d_logit = ((p - labels) / len(labels)).astype(np.float32)
    g = {"out": pooled.T @ d_logit, "out_c": np.array([d_logit.sum()])}
    d_pooled = d_logit[:, None] * w["out"]
    d_e = np.einsum("bh,tbh->tb", d_pooled, states)
    d_states = e[:, :, None] * d_pooled
    d_score = e * (d_e - (e * d_e).sum(axis=0))
    d_u = d_score[:, :, None] * w["query"] * (1 - u * u)
    g["query"] = np.einsum("tba,tb->a", u, d_score)
    flat = d_u.reshape(-1, d_u.shape[2])
    g["attend"] = states.reshape(-1, 2 * h).T @ flat
    g["attend_c"] = flat.sum(axis=0)
    d_states = d_states + d_u @ w["attend"].T
    d_x = np.zeros_like(x)
    for k, way in enumerate("fb"):
        own = d_states[:, :, k * h : (k + 1) * h]
        d_gates = np.empty((index.shape[1], len(index), 3 * h), np.float32)
        g["h" + way] = np.zeros_like(w["h" + way])
        carry = np.zeros((len(index), h), np.float32)
        for t, z, reset, n, rn, before in reversed(keeps[way]):
            d = own[t] + carry
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (before - n) * z * (1 - z)
            d_r = d_n * rn * reset * (1 - reset)
            d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            into = np.concatenate([d_z, d_r, d_n * reset], axis=1)
            g["h" + way] += before.T @ into
            carry = d * z + into @ w["h" + way].T
        d_gates[pad] = 0
        sums = np.empty((len(used), 3 * h), np.float32)
        at = local.T.reshape(-1)
        flat = d_gates.reshape(-1, 3 * h)
        for c in range(3 * h):
            sums[:, c] = np.bincount(at, flat[:, c], len(used))
        g["c" + way] = sums.sum(axis=0)
        g["x" + way] = x.T @ sums
        d_x += sums @ w["x" + way].T
    return loss, g, used, d_x


class _Trainable(Vocabulary):
    """A vocabulary whose words' inputs can be made, and trained, for some of them."""

    def rows(self) -> None:
        super().rows()
        self.first = np.searchsorted(self.gram_word, np.arange(len(self.word) + 1))

    def _grams(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.first[used + 1] - self.first[used]
        at = np.repeat(np.arange(len(used)), sizes)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return at, self.gram[self.first[used][at] + inner]

    def inputs_of(self, w: dict[str, np.ndarray], used: np.ndarray) -> np.ndarray:
        at, rows = self._grams(used)
        self.kept = at, rows
        own = w["word"][self.word[used]] * self.shown[used][:, None]
        grams = np.zeros((len(used), w["gram"].shape[1]), np.float32)
        values = w["gram"][rows]
        for d in range(grams.shape[1]):
            grams[:, d] = np.bincount(at, values[:, d], len(used)) / self.count[used]
        x = np.concatenate([own, grams], axis=1)
        x[0] = 0
        return x


def train_network(windows: np.ndarray, labels: np.ndarray, vocabulary: _Trainable, s: Settings):
    """Adam over balanced batches of windows; a window's label is its document's."""
    rng = np.random.default_rng(s.seed)
    w = _initial(s)
    dense = [k for k in w if k not in ("word", "gram")]
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    of_class = [np.flatnonzero(labels == c) for c in (0, 1)]
    for step in range(1, s.steps + 1):
        pick = np.concatenate([rng.choice(c, s.batch // 2) for c in of_class])
        vocabulary.shown = (rng.random(len(vocabulary.word)) >= s.word_dropout).astype(np.float32)
        _, g, used, d_x = _backward(w, s, vocabulary, windows[pick], labels[pick])
        d_x[0] = 0
        at, rows = vocabulary.kept
        own_rows, own_at = np.unique(vocabulary.word[used], return_inverse=True)
        d_own = np.zeros((len(own_rows), s.word_size), np.float32)
        np.add.at(d_own, own_at, d_x[:, : s.word_size] * vocabulary.shown[used][:, None])
        gram_used, gram_at = np.unique(rows, return_inverse=True)
        scaled = (d_x[:, s.word_size :] / vocabulary.count[used][:, None])[at]
        d_gram = np.empty((len(gram_used), s.gram_size), np.float32)
        for d in range(s.gram_size):
            d_gram[:, d] = np.bincount(gram_at, scaled[:, d], len(gram_used))
        rate = s.rate * min(1.0, 3 * (1 - step / (s.steps + 1)))
        norm = np.sqrt(sum(float((g[k] ** 2).sum()) for k in dense))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        parts = [(k, slice(None), g[k] * clip) for k in dense]
        parts += [("word", own_rows, d_own), ("gram", gram_used, d_gram)]
        for k, at_rows, grad in parts:
            m = first[k][at_rows] * 0.9 + 0.1 * grad
            v = second[k][at_rows] * 0.99 + 0.01 * grad * grad
            first[k][at_rows], second[k][at_rows] = m, v
            fix = (1 - 0.9**step), (1 - 0.99**step)
            move = rate * (m / fix[0]) / (np.sqrt(v / fix[1]) + 1e-7)
            w[k][at_rows] -= move.astype(np.float32)
    return w


def _portions(texts, most_words: int) -> Iterator[list[list[str]]]:
    """Texts as word lists, in portions of bounded words; a longer text is a portion itself."""
    part, total = [], 0
    for t in texts:
        words = split_words(t)
        if part and total + len(words) > most_words:
            yield part
            part, total = [], 0
        part.append(words)
        total += len(words)
    if part:
        yield part


def _index_windows(docs: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(windows [n, window], document of each)."""
    starts = [windows_of(len(d), s) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(x) for x in starts])
    flat = np.concatenate([*docs, np.zeros(s.window, np.int32)])
    base = np.cumsum([0, *(len(d) for d in docs)])
    begin = np.concatenate([base[k] + np.array(x) for k, x in enumerate(starts)])
    limit = base[1:][owner]
    at = begin[:, None] + np.arange(s.window)
    return np.where(at < limit[:, None], flat[np.minimum(at, len(flat) - 1)], 0), owner


def doc_features(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """[document, 4]: one, and the mean, the highest and the share above 0 of window logits."""
    logits = np.clip(logits, -12, 12).astype(np.float64)
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, logits)
    mean = np.bincount(owner, logits, n) / count
    share = np.bincount(owner, logits > 0, n) / count
    return np.stack([np.ones(n), mean, top, share], axis=1)


def text_features(texts, weights: dict[str, np.ndarray], s: Settings) -> np.ndarray:
    """``doc_features`` of whole texts by all their windows; zeros for a text without words."""
    out = [np.zeros((0, 4))]
    for part in _portions(texts, 400_000):
        vocabulary = Vocabulary(s)
        docs = [vocabulary.index(words) for words in part]
        vocabulary.rows()
        windows, owner = _index_windows(docs, s)
        logits = window_logits(windows, vocabulary.inputs(weights), weights)
        features = doc_features(logits, owner, len(docs))
        features[[not len(d) for d in docs]] = 0
        out.append(features)
    return np.concatenate(out)


def score_texts(texts, model: Model) -> np.ndarray:
    """Scores of whole texts; one without words gets the training sample's share of toxic ones."""
    if model.weights is None:
        return np.full(len(texts), model.prior)
    features = text_features(texts, model.weights, model.settings)
    z = features @ model.doc_weights
    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.where(features[:, 0] > 0, score, model.prior)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
    return beta


def drawn_windows(text: str | None, s: Settings) -> list[list[str]]:
    """The words of at most ``windows_per_doc`` windows, drawn over the whole text."""
    words = split_words(text)
    starts = windows_of(len(words), s) if words else []
    if len(starts) > s.windows_per_doc:
        rng = np.random.default_rng([s.seed, zlib.crc32(text.encode("utf-8", "replace"))])
        starts = sorted(rng.choice(starts, s.windows_per_doc, replace=False).tolist())
    return [words[a : a + s.window] for a in starts]


def _set_aside(labels: np.ndarray) -> np.ndarray:
    """Every fifth document of each class, at least one: these fit the document function."""
    rank = np.zeros(len(labels), int)
    for c in (0, 1):
        rank[labels == c] = np.arange((labels == c).sum())
    return rank % 5 == 1


def _document_weights(labels: np.ndarray, rates: tuple[float, float]) -> np.ndarray:
    """The sampled shares of clean and toxic documents, turned back into the labels' own odds."""
    return np.where(labels > 0, 1 / max(rates[1], 1e-9), 1 / max(rates[0], 1e-9))


def _learn(windows: list[list[str]], of_window: np.ndarray, s: Settings):
    """The network's weights; none if the windows lack a class."""
    if len(set(of_window.tolist())) < 2:
        return None
    vocabulary = _Trainable(s)
    index, _ = _index_windows([vocabulary.index(words) for words in windows], s)
    vocabulary.rows()
    return train_network(index, of_window.astype(np.float32), vocabulary, s)


def _too_few(labels: np.ndarray) -> bool:
    return len(labels) < 4 or min((labels == 0).sum(), (labels == 1).sum()) < 2


def _prior(labels: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * labels).sum() / weight.sum()) if len(labels) else 0.0


def train(texts: list[str], labels: np.ndarray, rates: tuple[float, float], s: Settings) -> Model:
    """Network on four fifths of the texts, the document function on the rest, in one process.

    ``rates`` are the sampled shares of clean and toxic documents; the rest is weighed
    by them, so scores follow the labels' own odds.
    """
    labels = np.asarray(labels)
    weight = _document_weights(labels, rates)
    prior = _prior(labels, weight)
    if _too_few(labels):
        return Model(s, None, prior=prior)
    aside = _set_aside(labels)
    drawn = [(words, c) for t, c, a in zip(texts, labels, aside) if not a for words in drawn_windows(t, s)]
    w = _learn([words for words, _ in drawn], np.array([c for _, c in drawn]), s)
    if w is None:
        return Model(s, None, prior=prior)
    features = text_features([t for t, a in zip(texts, aside) if a], w, s)
    beta = _logistic(features, labels[aside], weight[aside] / weight[aside].mean())
    return Model(s, w, beta, prior)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, s: Settings
) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, toxic, t) of at most ``docs_per_class`` documents of each class, whole texts.

    They are taken by hash of the id from rows where ``learn``, and written.  Only the
    sampled ids (a bounded set) meet the documents, so other texts do not move.  An id
    labelled both ways counts as toxic; null ids and labels are left out.  Also gives the
    shares of both classes that were sampled.
    """
    known = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(learn)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id")
        part = part.limit(s.docs_per_class)
        ids = part if ids is None else ids.unionByName(part)
    spark = docs.sparkSession
    chosen = spark.createDataFrame(ids.collect(), ids.schema)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t")).join(F.broadcast(chosen), "doc_id")
    # A repeated id gives one text, so the sample stays bounded.
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    rows = freeze(rows.groupBy("doc_id", "toxic").agg(F.min("t").alias("t")), "toxicity-sample")
    taken = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    return rows, tuple(taken.get(c, 0) / counts[c] if counts.get(c) else 1.0 for c in (0, 1))


def _draw(s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [
                (place, nth, " ".join(words))
                for place, text in zip(rows["place"], rows["t"])
                for nth, words in enumerate(drawn_windows(text, s))
            ]
            yield pd.DataFrame(found, columns=["place", "nth", "words"])

    return run


def _features(shared, s: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = text_features(rows["t"].tolist(), shared.value, s)
            yield pd.DataFrame({"place": rows["place"], "f": found.tolist()})

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, s: Settings = Settings()):
    """Train on labelled documents; ``learn`` tells by ``doc_id`` which may be learned from.

    As ``train``, but texts stay in tasks: the driver gets drawn windows (their number is
    bounded) and four figures per document set aside.  Null texts count as empty, a
    repeated id gives one text, other columns are not read; without documents of both
    classes, so for empty tables too, every score is the share of toxic ones.
    """
    spark = docs.sparkSession
    importable(spark)
    sample, rates = labelled_sample(docs, labels, F.lit(True) if learn is None else learn, s)
    named = sample.select("doc_id", "toxic").collect()
    named.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    toxic = np.array([r["toxic"] for r in named], dtype=int)
    weight = _document_weights(toxic, rates)
    prior = _prior(toxic, weight)
    if _too_few(toxic):
        return Model(s, None, prior=prior)
    aside = _set_aside(toxic)
    schema = StructType(
        [sample.schema["doc_id"], StructField("place", IntegerType()), StructField("aside", BooleanType())]
    )
    places = [(r["doc_id"], k, bool(aside[k])) for k, r in enumerate(named)]
    rows = sample.join(F.broadcast(spark.createDataFrame(places, schema)), "doc_id")
    drawn = rows.where("NOT aside").select("place", "t")
    drawn = drawn.mapInPandas(releasing(_draw(s)), "place int, nth int, words string").collect()
    drawn.sort(key=lambda r: (r["place"], r["nth"]))
    w = _learn([r["words"].split(" ") for r in drawn], toxic[[r["place"] for r in drawn]], s)
    del drawn
    if w is None:
        return Model(s, None, prior=prior)
    shared = spark.sparkContext.broadcast(w)
    read = rows.where("aside").select("place", "t")
    read = read.mapInPandas(releasing(_features(shared, s)), "place int, f array<double>").collect()
    read.sort(key=lambda r: r["place"])
    at = [r["place"] for r in read]
    beta = _logistic(np.array([r["f"] for r in read]), toxic[at], weight[at] / weight[at].mean())
    release_memory()
    return Model(s, w, beta, prior)


def toxicity(text: Column, model: Model, spark) -> Column:
    """The score (0 to 1) of a whole text; null and empty texts get the prior.

    Every row is scored by its text alone: repeated rows get the same score, other columns
    are not read, and a table without rows gives none.
    """
    importable(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series(score_texts(texts.tolist(), shared.value), dtype="float64")
        finally:
            release_memory()

    return of_texts(text.cast("string"))
