"""Spelling variants: words one letter apart, found by partition-and-enumerate signatures.

A word's letters form a binary vector: component (letter, k) is set if the letter occurs
at least k times.  An inserted or deleted letter changes one component, a replaced one
two, so words one edit apart are vectors at a Hamming distance of at most two.  The
components are dealt to ``parts`` parts by hash.  Two such vectors differ in at most two
parts, so leaving out some two parts makes the rest equal: a word has one signature for
each pair of parts, a hash of the components outside it.  One edit also leaves the first or
the last three of seven letters alone, so every signature is made twice, with either.  Equal
signatures are joined, pairs verified.  More parts make signatures more selective and more
of them; the result is the same.

A pair is passed on only from the first signature that it must share, so no pair comes
twice.  A signature of very many words is compared in blocks (``blocks``).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import close_pairs, paired_blocks, shared_keys, whole_groups
from .tables import dealt_evenly, freeze, importable

# Fixed values of the contract: letters, thinning by crc32, least length and count, ratio of counts.
LEAST_LETTERS, LEAST_COUNT, RATIO, THINNED = 7, 2, 10, 31
LETTERS = bytes([*range(0x61, 0x7B), *range(0xC0, 0x100)])

HELD_WORDS = 500_000  # distinct words that a task holds before it passes counts on
WORDS_PER_TASK = 50_000
ROWS_AT_ONCE = 100_000  # of the signature table, in a comparison
SIGNATURE_BITS = 8  # of a key, which tell its pair of parts and its end
END_LETTERS = (LEAST_LETTERS - 1) // 2
FEWEST_PARTS, MOST_PARTS = 4, 16

_FOLDED = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
# Characters above ASCII whose lead byte is not 0xC3 lie outside U+00C0 to U+00FF.
_OUTSIDE = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")


def runs(raw: bytes) -> list[bytes]:
    """Maximal runs of letters of a UTF-8 text, A-Z in lower case."""
    if not raw.isascii():
        raw = _OUTSIDE.sub(b" ", raw)
    return raw.translate(_FOLDED).split()


def thinned(run: bytes, h: int) -> bytes:
    """``run`` without its code point number ``h`` modulo its length, where 31 divides ``h``."""
    if h % THINNED:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    crc32, least = zlib.crc32, LEAST_LETTERS
    found: dict[bytes, int] = {}

    def passed_on():
        words = [w.decode() for w in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        texts = batch.column("text")
        for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            prefix = crc32(f"{doc_id}:".encode())
            for run, n in Counter(runs(texts[k].as_py())).items():
                if len(run) >= least:
                    h = crc32(run, prefix)
                    word = run if h % THINNED else thinned(run, h)
                    # A letter above ASCII takes two bytes, the first of them 0xC3.
                    if len(word) - word.count(b"\xc3") >= least:
                        found[word] = found.get(word, 0) + n
            if len(found) > HELD_WORDS:
                yield passed_on()
                found.clear()
    yield passed_on()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with enough occurrences, for rows (doc_id string, text binary)."""
    counted = docs.mapInArrow(_count_words, "word string, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# --- signatures ---------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def component(letter: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A hash of component (letter, k), k from 1."""
    mixed = letter.astype(np.uint64) << np.uint64(32) | k.astype(np.uint64)
    return _mix((mixed + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def part_of(components: np.ndarray, parts: int) -> np.ndarray:
    return ((components >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def left_out(parts: int) -> list[tuple[int, int]]:
    """The pairs of parts, in the order of their numbers."""
    return list(combinations(range(parts), 2))


def _pair_numbers(parts: int) -> np.ndarray:
    """The number of the first signature that leaves out both parts of a difference."""
    out = np.zeros((parts, parts), np.int64)
    for number, (a, b) in enumerate(left_out(parts)):
        out[a, b] = out[b, a] = number
    for a in range(parts):
        out[a, a] = out[0, a or 1]
    return out


class Words:
    """Words as Latin-1 letters in one array."""

    def __init__(self, words: list[str]):
        self.data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def ends(self, last: bool) -> np.ndarray:
        """The first or last letters as one number; words must not be shorter."""
        first = self.starts + (self.lengths - END_LETTERS if last else 0)
        found = np.full(len(self.starts), 1 + last, np.uint64)
        for k in range(END_LETTERS):
            found = (found << np.uint64(8)) | self.data[first + k]
        return _mix(found * np.uint64(0x9E3779B97F4A7C15))

    def signatures(self, parts: int) -> np.ndarray:
        """Keys, two columns for each pair of parts: with the first and with the last letters.

        The low bits of a key are the number of its column.
        """
        owner = self.owners()
        order = np.lexsort((self.data, owner))
        letter, owner = self.data[order], owner[order]
        new = np.ones(len(letter), bool)
        new[1:] = (letter[1:] != letter[:-1]) | (owner[1:] != owner[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(letter)), 0))
        found = component(letter, np.arange(len(letter)) - first + 1)
        sums = np.zeros((len(self.lengths), parts), np.uint64)
        np.add.at(sums, (owner, part_of(found, parts)), found)
        whole = sums.sum(axis=1, dtype=np.uint64)
        keys = np.empty((len(sums), 2 * len(left_out(parts))), np.uint64)
        low = np.uint64(SIGNATURE_BITS)
        ends = self.ends(False), self.ends(True)
        for number, (a, b) in enumerate(left_out(parts)):
            for last in (0, 1):
                rest = _mix(whole - sums[:, a] - sums[:, b] + ends[last])
                column = 2 * number + last
                keys[:, column] = (rest >> low << low) | np.uint64(column)
        return keys.view(np.int64)

    def alike(self, i: np.ndarray, j: np.ndarray, end: bool) -> np.ndarray:
        """How many first (or last) letters two words have in common."""
        least = np.minimum(self.lengths[i], self.lengths[j])
        one = self.starts[i] + (self.lengths[i] - 1 if end else 0)
        two = self.starts[j] + (self.lengths[j] - 1 if end else 0)
        same = np.zeros(len(i), np.int64)
        open_, k = np.flatnonzero(least > 0), 0
        while len(open_):
            step = -k if end else k
            open_ = open_[self.data[one[open_] + step] == self.data[two[open_] + step]]
            k += 1
            same[open_] = k
            open_ = open_[least[open_] > k]
        return same

    def times(self, rows: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """How often each row's word holds a letter."""
        found = np.zeros(len(rows), np.int64)
        open_, k = np.arange(len(rows)), 0
        while len(open_):
            found[open_] += self.data[self.starts[rows[open_]] + k] == letter[open_]
            k += 1
            open_ = open_[self.lengths[rows[open_]] > k]
        return found


_WEIGHTS = np.zeros(256, np.uint64)
_WEIGHTS[list(LETTERS)] = _mix(np.arange(1, len(LETTERS) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _changes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By ascending difference of two words' weights: the letter that goes and the one that comes.

    0 stands for no letter, so insertions and deletions are among them.
    """
    letters = np.array([0, *LETTERS], np.uint8)
    goes, comes = (x.ravel() for x in np.meshgrid(letters, letters, indexing="ij"))
    goes, comes = goes[goes != comes], comes[goes != comes]
    difference = _WEIGHTS[comes] - _WEIGHTS[goes]
    order = np.argsort(difference)
    return difference[order], goes[order], comes[order]


_DIFFERENCE, _GOES, _COMES = _changes()
# One bit per letter; some letters above ASCII share one.
_BITS = np.zeros(256, np.uint64)
_BITS[list(LETTERS)] = [1 << (k if k < 26 else 26 + (k - 26) % 38) for k in range(len(LETTERS))]


class Verifier:
    """Exact test for words one edit apart, in the first signature that they share."""

    def __init__(self, words: Words, numbers: np.ndarray, parts: int):
        self.words, self.numbers, self.parts = words, numbers, parts
        self.first = _pair_numbers(parts)
        self.weights = np.add.reduceat(_WEIGHTS[words.data], words.starts)
        self.odd = np.bitwise_xor.reduceat(_BITS[words.data], words.starts)

    def maybe(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A quick test that near words pass.

        At most two letters occur odd times in one word and even times in the other, and
        the letters aren't the same.
        """
        few = np.bitwise_count(self.odd[i] ^ self.odd[j]) <= 2
        return few & (self.weights[i] != self.weights[j])

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        w, out = self.words, np.zeros(len(i), bool)
        own = np.flatnonzero(np.abs(w.lengths[i] - w.lengths[j]) <= 1)
        # One letter more, less or another: the weights tell which.
        difference = self.weights[j[own]] - self.weights[i[own]]
        at = np.minimum(np.searchsorted(_DIFFERENCE, difference), len(_DIFFERENCE) - 1)
        hit = _DIFFERENCE[at] == difference
        own, at = own[hit], at[hit]
        a, b = i[own], j[own]
        first, last = w.alike(a, b, False), w.alike(a, b, True)
        hit = first + last >= np.maximum(w.lengths[a], w.lengths[b]) - 1
        # Words that begin alike are taken from the signatures with the first letters only.
        hit &= (self.numbers[a] & 1 == 0) | (first < END_LETTERS)
        own, at, a, b = own[hit], at[hit], a[hit], b[hit]
        goes, comes = _GOES[at], _COMES[at]
        lost = part_of(component(goes, w.times(a, goes)), self.parts)
        won = part_of(component(comes, w.times(b, comes)), self.parts)
        lost, won = np.where(goes == 0, won, lost), np.where(comes == 0, lost, won)
        out[own[self.first[lost, won] == self.numbers[a] >> 1]] = True
        return out


def _sign(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                keys = Words(own.column("word").to_pylist()).signatures(parts)
                row = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), own.column("word").take(row), own.column("n").take(row)],
                    ["key", "word", "n"],
                )

    return run


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together, as a comparison's cost is partly by batch."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _compare(parts: int):
    low = (1 << SIGNATURE_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(_larger(batches)):
            word, n = rows["word"].combine_chunks(), rows["n"].combine_chunks()
            numbers = rows["key"].to_numpy() & low
            check = Verifier(Words(word.to_pylist()), numbers, parts)
            blocks = rows["block_a"].to_numpy(), rows["block_b"].to_numpy()
            for i, j in close_pairs(starts, rows["side"].to_numpy(), blocks, check.maybe):
                near = check.near(i, j)
                i, j = i[near], j[near]
                one, two = pa.array(np.append(i, j)), pa.array(np.append(j, i))
                yield pa.RecordBatch.from_arrays(
                    [word.take(one), word.take(two), n.take(two)], ["word", "near", "near_n"]
                )

    return run


def near_words(words: DataFrame, parts: int | None = None) -> DataFrame:
    """(word, near, near_n), every ordered pair of different words (word, n) one edit apart.

    ``words`` must be a written table of different words of the contract's letters and
    length.  Without ``parts`` their number follows the number of words: signatures grow with
    the square of its logarithm, and what meets by chance under one stays rare.
    """
    if parts is None:
        parts = 2 * round(math.log2(max(2, words.count())) / 4 - 3)
        parts = min(MOST_PARTS, max(FEWEST_PARTS, parts))
    if not 3 <= parts <= MOST_PARTS:
        raise ValueError(f"parts must be between 3 and {MOST_PARTS}")
    signed = dealt_evenly(words.select("word", "n"), WORDS_PER_TASK).mapInArrow(
        _sign(parts), "key long, word string, n long"
    )
    dealt = paired_blocks(shared_keys(signed), "word")
    dealt = dealt.select("key", "block_a", "block_b", "side", "word", "n")
    return dealt.mapInArrow(_compare(parts), "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, each round twice as far.

    Counts rise along forms, so there are no circles and few rounds.
    """
    found = freeze(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = found.select(F.col("word").alias("via"), F.col("root").alias("next"))
        if not found.join(on, F.col("root") == F.col("via"), "left_semi").limit(1).count():
            return found
        further = found.join(on, F.col("root") == F.col("via"), "left")
        found = freeze(further.select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    parts: int | None = None,
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per word.

    Words are the thinned runs of letters of all texts with at least ``LEAST_LETTERS``
    letters and ``LEAST_COUNT`` occurrences; near words are one inserted, deleted or replaced
    letter apart.  ``form`` is the near word of largest ``n`` (ties: the least by code
    point) if that is at least ``RATIO`` times the word's, ``root`` the end of the chain of forms.

    Null and empty texts have no words; a null id is thinned as an empty one.  Repeated rows
    count again.  A run of any length is a word.  No rows give none.  Columns other than the
    two named are not read.
    """
    importable(docs.sparkSession)
    own = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    words = freeze(word_counts(own), "words")
    # The least of (-n, word): the largest count, then the least word.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, parts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    big = -F.col("best.less") >= RATIO * F.col("n")
    joined = freeze(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(big, F.col("best.near")).alias("form"),
            F.when(big, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
