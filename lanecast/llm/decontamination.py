"""Benchmark decontamination: edit-similar passages found through CGK embeddings.

Texts and items are sequences of words (lower-cased letters and digits).  A passage
leaks an item of ``n`` words if its edit distance to the item, in words, is at most
``floor(0.2 * n)``.

The CGK embedding walks over a sequence: at step ``j`` it writes the word it stands on
and moves on if a random bit of (``j``, word) is set.  Two sequences at a small edit
distance fall into step again after each edit, so their embeddings are close in
Hamming distance, and sampling a few positions of the embedding is a locality
sensitive hash for it.  Each table is one walk with one sample of positions; the
number of tables follows from the target recall, measured on the items
themselves with as many random edits as are allowed.

Walks lose their step over long items, so an item of more than ``PIECE_WORDS`` words is
searched by pieces of nearly equal length.  At least one piece of a leaked item is edited in no more
than the share that is allowed, so it is found as an item of its length would be; the
whole item is compared around it.  Should a length group miss the recall with ``MOST_TABLES``
tables, its pieces are searched without tables: every window that meets the conditions below is
compared.

Items (or pieces) are grouped by length.  For each group every document position starts a window
of the items' size; the windows whose sampled words all agree with an item's, in some
table, are compared with it by exact edit distance.  Conditions that every true match meets
drop most windows first.  A passage keeps all but the allowed edits of the item's words,
so it holds enough words of any item, enough of the item's words that are rare in the
texts at hand, and, for a candidate, enough words of the item itself.  Windows leave a
table as soon as the words sampled so far fit no item.

The benchmark is cut into chunks of bounded bytes; each chunk's tables are built once
and go to the executors, and the documents stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import importable, releasing, texts_of

WORDS = re.compile(r"[^\W_]+")
# Scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han); each letter is a word.
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
    "\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
)
UNSPACED_LETTER = re.compile(f"[{UNSPACED}]")
MIXED_WORDS = re.compile(f"(?![_\\W])[{UNSPACED}]|[^\\W_{UNSPACED}]+")

EDIT_SHARE = 0.2  # edits allowed per word of the item
RECALL = 0.95  # of windows with as many edits as allowed, by their aligned start alone
POSITIONS = 4  # sampled positions of an embedding in a table
WALKS = 8  # tables share them
FIRST_POSITIONS = (0, 2, 4, 6)  # the first sampled position; tables of a walk share it
MOST_TABLES = 96  # a length group that needs more is searched without tables
PIECE_WORDS = 60  # longer items are searched by pieces
LENGTH_RATIO = 1.25  # longest to shortest item of a length group
RARE_MASSES = (0.005, 0.01, 0.02, 0.04, 0.08)  # shares of a text that its rarest words make up
SHORT = 5  # an item of fewer words is searched as an exact passage, one of a single word as a whole text
WALKED = 1 << 18  # windows that walk together
CHUNK_BYTES = 16 << 20  # of items that executors hold at once


def split_words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; single letters in scripts written without spaces."""
    if not text:
        return []
    text = text.lower()
    unspaced = not text.isascii() and UNSPACED_LETTER.search(text)
    return (MIXED_WORDS if unspaced else WORDS).findall(text)


def _lowered_bytes() -> bytes:
    """For texts of Latin-1: the lower-case letter or digit of each byte, else a space."""
    lowered = (chr(b).lower() for b in range(256))
    return b"".join(c.encode("latin-1") if WORDS.fullmatch(c) else b" " for c in lowered)


LOWERED = _lowered_bytes()


def latin_words(text: str) -> list[bytes] | None:
    """As ``split_words``, in Latin-1 bytes; none if the text has other characters."""
    try:
        return text.encode("latin-1").translate(LOWERED).split()
    except UnicodeEncodeError:
        return None


def allowed_edits(n_words: int, share: float = EDIT_SHARE) -> int:
    return int(n_words * share + 1e-9)


END, OTHER = 0, 1  # symbols; words of items follow


def random_bits(n_symbols: int, steps: int) -> np.ndarray:
    """[walk, 64 steps each, symbol]: one random bit per step says whether the walk moves on.

    The end's bits are 0: a walk that has reached the end of its text stays there.
    """
    words = -(-steps // 64)
    symbols = np.arange(n_symbols, dtype=np.uint64)
    out = np.empty((WALKS, words, n_symbols), dtype=np.uint64)
    for k in range(WALKS * words):
        h = (symbols + np.uint64(k * 0x9E3779B1 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift in (30, 27, 31):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
        out[k // words, k % words] = h ^ (h >> np.uint64(32))
    out[:, :, END] = 0
    return out


class Walk:
    """CGK walks of many windows at once; words and places are platform integers, which index fastest.

    ``bits`` are one walk's, by symbol; ``moves`` holds them by place, for each 64 steps.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, bits: Iterable[np.ndarray]):
        self.words, self.at, self.step = words, at, 0
        self.moves = [block.take(words) for block in bits]

    def symbols(self, position: int) -> np.ndarray:
        """The embeddings' symbols at a position not before the last one asked for."""
        while self.step < position:
            move = self.moves[self.step >> 6].take(self.at)
            move >>= np.uint64(self.step & 63)
            move &= np.uint64(1)
            self.at = self.at + move.view(np.int64)
            self.step += 1
        return self.words.take(self.at)

    def standing(self, at: np.ndarray) -> Walk:
        """Windows that stand at ``at`` after the same number of steps."""
        other = Walk(self.words, at, ())
        other.moves, other.step = self.moves, self.step
        return other


def joined(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol sequences one after another, each followed by the end; and their starts."""
    sizes = np.array([len(x) + 1 for x in sequences])
    out = np.full(sizes.sum(), END, dtype=np.int32)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = np.concatenate(sequences)
    return out, (np.cumsum(sizes) - sizes).astype(np.int32)


def _mix(taken: list[np.ndarray], h: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit value of the symbols sampled so far, of which ``h`` holds the first ones."""
    if h is None:
        h = np.zeros(len(taken[0]), dtype=np.uint64)
    for t in taken:
        h = (h ^ (t + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _maybe(known: np.ndarray) -> np.ndarray:
    """By their highest bits, whether hashes may be known; few others may."""
    bits = max(4, (16 * len(known)).bit_length())
    out = np.zeros(1 << bits, dtype=bool)
    out[(known >> np.uint64(64 - bits)).astype(np.intp)] = True
    return out


def banded_distances(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(least edit distance of item to any passage of text, the passage's begin, end).

    Among equal distances the longest passage that ends first.
    """
    n = len(text)
    cost = np.zeros(n + 1, dtype=np.int64)
    begin = np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, w in enumerate(item):
        up = cost + 1
        diagonal = np.concatenate([[k + 1], cost[:-1] + (text != w)])
        from_diagonal = np.concatenate([[0], begin[:-1]])
        take = diagonal <= up
        best = np.where(take, diagonal, up)
        origin = np.where(take, from_diagonal, begin)
        # Words of the text between two words of the item: a running minimum to the right.
        key = (best - steps) * (n + 2) + steps
        least = np.minimum.accumulate(key)
        source = np.mod(least, n + 2)
        cost = best[source] + steps - source
        begin = origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


@dataclass
class Table:
    """One walk with sampled positions, and what the items read there."""

    walk: int
    positions: list[int]
    first: np.ndarray  # whether a symbol is read by some item at the first position
    known: list[np.ndarray]  # sorted hashes of the symbols up to each position
    maybe: list[np.ndarray]  # whether hashes with the same highest bits are among them
    hashes: np.ndarray  # of all positions, sorted
    items: np.ndarray  # beside ``hashes``


@dataclass
class LengthGroup:
    """Pieces (whole items, if short) of similar length with their hash tables, or none if these miss the recall."""

    items: np.ndarray
    shortest: int
    longest: int
    known_words: int  # words of any item that a true match has at least
    tables: list[Table] | None


def pieces(words: np.ndarray) -> list[np.ndarray]:
    """The words in as few pieces of at most ``PIECE_WORDS`` as there can be, of nearly equal length."""
    return np.array_split(words, -(-len(words) // PIECE_WORDS))


def _reach(shortest: int) -> int:
    """Positions to sample from: a walk that far rarely leaves the shortest item."""
    return max(POSITIONS + FIRST_POSITIONS[-1], int(1.6 * shortest))


class Chunk:
    """Some items, ready for matching: word ids, item sequences, tables by length group.

    ``words``, ``sizes`` and ``edits`` are the pieces', ``item_words`` the items'.
    """

    def __init__(self, items: list[tuple], share: float = EDIT_SHARE, recall: float = RECALL):
        self.share = share
        self.ids: dict[str, int] = {}
        self.keys, self.item_words, self.words = [], [], []
        owners, offsets = [], []
        self.short: dict[tuple[int, ...], list] = {}  # keys of items of few words, by word ids
        for key, text in items:
            words = split_words(text)
            if not words:
                continue
            row = [self.ids.setdefault(w, len(self.ids) + OTHER + 1) for w in words]
            if len(words) < SHORT:
                self.short.setdefault(tuple(row), []).append(key)
                continue
            at = 0
            for piece in pieces(np.array(row, dtype=np.int32)):
                self.words.append(piece)
                owners.append(len(self.keys))
                offsets.append(at)
                at += len(piece)
            self.keys.append(key)
            self.item_words.append(np.array(row, dtype=np.int32))
        self.owners, self.offsets = np.array(owners, dtype=np.int64), np.array(offsets, dtype=np.int64)
        self.n_symbols = len(self.ids) + OTHER + 1
        self.latin_ids = {w.encode("latin-1"): k for w, k in self.ids.items() if max(w) <= "\xff"}
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.edits = np.array([allowed_edits(n, share) for n in self.sizes], dtype=np.int64)
        longest = int(self.sizes.max()) if len(self.sizes) else 0
        self.bits = random_bits(self.n_symbols, _reach(longest))
        self.groups: list[LengthGroup] = []
        part: list[int] = []
        for k in np.argsort(self.sizes, kind="stable").tolist():
            if part and self.sizes[k] > LENGTH_RATIO * self.sizes[part[0]]:
                self.groups.append(self._group(part, recall))
                part = []
            part.append(k)
        if part:
            self.groups.append(self._group(part, recall))

    def _group(self, items: list[int], recall: float) -> LengthGroup:
        sizes = self.sizes[items]
        shortest = int(sizes[0])
        rng = np.random.default_rng(shortest)
        drawn = []
        for t in range(MOST_TABLES):
            first = int(rng.choice(FIRST_POSITIONS))
            rest = rng.choice(np.arange(first + 1, _reach(shortest)), POSITIONS - 1, replace=False)
            drawn.append((t % WALKS, [first, *np.sort(rest).tolist()]))
        n = self._tables_needed(items, drawn, recall, rng)
        keep = int((sizes - self.edits[items]).min())
        if n is None:
            return LengthGroup(np.array(items), shortest, int(sizes[-1]), keep, None)
        tables = []
        for table in drawn[:n]:
            taken = self.sampled([self.words[k] for k in items], table)
            first = np.zeros(self.n_symbols, dtype=bool)
            first[taken[0]] = True
            known = [np.unique(_mix(taken[: p + 1])) for p in range(POSITIONS)]
            last = _mix(taken)
            by_hash = np.argsort(last, kind="stable")
            own = np.array(items)[by_hash]
            tables.append(Table(*table, first, known, list(map(_maybe, known)), last[by_hash], own))
        return LengthGroup(np.array(items), shortest, int(sizes[-1]), keep, tables)

    def sampled(self, sequences, table) -> list[np.ndarray]:
        """The symbols of whole sequences at a table's positions."""
        words, starts = joined(list(sequences))
        walk = Walk(words.astype(np.intp), starts.astype(np.intp), self.bits[table[0]])
        return [walk.symbols(p) for p in table[1]]

    def _tables_needed(self, items, drawn, recall, rng) -> int | None:
        """Tables until edited copies of (a bounded number of) the items meet the recall, if they do."""
        probes = [items[k] for k in rng.permutation(len(items))[:64]]
        pairs = []
        for k in probes:
            for _ in range(max(1, 256 // len(probes))):
                changed = self.words[k].tolist()
                for _ in range(self.edits[k]):
                    at, kind = int(rng.integers(len(changed))), rng.integers(3)
                    if kind == 0:
                        changed[at] = OTHER
                    elif kind == 1:
                        changed.insert(at, OTHER)
                    else:
                        del changed[at]
                pairs.append((self.words[k], np.array(changed, dtype=np.int32)))

        def hashes(sequences, table):
            return _mix(self.sampled(sequences, table))

        originals, edited = zip(*pairs)
        met = np.zeros(len(pairs), dtype=bool)
        for n, table in enumerate(drawn):
            met |= hashes(originals, table) == hashes(edited, table)
            if met.mean() >= recall:
                return n + 1
        return None

    def promising(self, words: np.ndarray, limits: np.ndarray) -> Iterator[np.ndarray]:
        """Per length group, the starts of windows that may hold a true match.

        Each item names the share of rarest words that tells it best from chance; a
        window must hold as many of those as some item that named the share keeps.
        """
        n = max(1, len(words))
        counts = np.bincount(words, minlength=self.n_symbols)
        by_count = np.argsort(counts[OTHER + 1 :], kind="stable") + OTHER + 1
        mass = np.cumsum(counts[by_count]) / n
        item_words = np.concatenate(self.words)
        begins = np.cumsum(self.sizes) - self.sizes
        rares, sure, better = [], [], []
        for share in RARE_MASSES:
            rare = np.zeros(self.n_symbols, dtype=bool)
            rare[by_count[mass <= share]] = True
            rares.append(rare)
            kept = np.add.reduceat(rare[item_words].astype(np.int64), begins) - self.edits
            by_chance = share * (self.sizes + self.edits)
            sure.append(kept)
            better.append((kept - by_chance) / np.sqrt(by_chance))
        sure, better = np.array(sure), np.array(better)
        named = np.where(better.max(axis=0) > 0, better.argmax(axis=0), -1)
        running = {
            k: np.concatenate([[0], np.cumsum(rares[k][words], dtype=np.int32)]) for k in set(named.tolist()) - {-1}
        }
        known = np.concatenate([[0], np.cumsum(words > OTHER, dtype=np.int32)])
        starts = np.arange(len(words))
        for group in self.groups:
            reach = np.minimum(starts + (group.longest + self.edits[group.items].max()), limits)
            good = known.take(reach) - known[:-1] >= group.known_words
            some = np.zeros(len(words), dtype=bool)
            for k in np.unique(named[group.items]).tolist():
                if k < 0:
                    some[:] = True
                else:
                    least = sure[k][group.items][named[group.items] == k].min()
                    some |= running[k].take(reach) - running[k][:-1] >= least
            yield starts[good & some]

    def candidates(self, words: np.ndarray, starts: list[np.ndarray]) -> list[np.ndarray]:
        """(start, piece) of windows that agree with a piece in some table; starts by length group."""
        out, grouped = [], []
        for own, group in zip(starts, self.groups):
            if group.tables is None:
                out.append(self.every_candidate(words, own, group))
            elif len(own):
                grouped.append((own, group))
        found, words = [], words.astype(np.intp)
        reach = max((t.positions[-1] for _, group in grouped for t in group.tables), default=0)
        for number in range(WALKS if grouped else 0):
            walk = Walk(words, words[:0], self.bits[number][: -(-reach // 64)])
            for own, group in grouped:
                by_first: dict[int, list[Table]] = {}
                for table in group.tables:
                    if table.walk == number:
                        by_first.setdefault(table.positions[0], []).append(table)
                for at in range(0, len(own), WALKED):
                    self._begin(by_first, walk.standing(own[at : at + WALKED]), found)
        return out + found

    def _begin(self, by_first: dict[int, list[Table]], walk: Walk, found: list) -> None:
        """Follow the tables of one walk by their first positions."""
        starts = walk.at
        for first, tables in sorted(by_first.items()):
            symbols = walk.symbols(first)
            alive = np.flatnonzero(tables[0].first.take(symbols))
            begun, own, h = walk.standing(walk.at[alive]), starts[alive], _mix([symbols[alive]])
            # They share the way to their second positions.
            for table in sorted(tables, key=lambda t: t.positions[1]):
                self._follow(table, begun, own, h, found)

    def every_candidate(self, words: np.ndarray, starts: np.ndarray, group: LengthGroup):
        """(start, piece) of all windows with enough words of the piece, whatever tables say."""
        found = []
        for k in group.items.tolist():
            member = np.zeros(self.n_symbols, dtype=bool)
            member[self.words[k]] = True
            running = np.concatenate([[0], np.cumsum(member[words], dtype=np.int32)])
            reach = np.minimum(starts + self.sizes[k] + self.edits[k], len(words))
            good = starts[running[reach] - running[starts] >= self.sizes[k] - self.edits[k]]
            if len(good):
                found.append(np.stack([good, np.full(len(good), k)], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else found

    def _follow(self, table: Table, walk: Walk, starts, h, found: list) -> None:
        """Add the (start, item) pairs that agree at the table's further positions too.

        ``h`` mixes the first symbols.  ``walk`` goes on to the second position.
        """
        for k, position in enumerate(table.positions[1:], 1):
            if not len(starts):
                return
            h, fits, maybe = _mix([walk.symbols(position)], h), table.known[k], table.maybe[k]
            highest = h >> np.uint64(65 - len(maybe).bit_length())
            good = np.flatnonzero(maybe.take(highest.view(np.int64)))
            good = good[fits.take(np.searchsorted(fits, h[good]), mode="clip") == h[good]]
            starts, walk, h = starts[good], walk.standing(walk.at[good]), h[good]
        low = np.searchsorted(table.hashes, h, "left")
        reps = np.searchsorted(table.hashes, h, "right") - low
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        items = table.items[np.repeat(low, reps) + inner]
        found.append(np.stack([np.repeat(starts, reps), items], axis=1))

    def short_matches(self, flat, begins, ends, owner) -> list[tuple]:
        """As ``matches``, of items of fewer than ``SHORT`` words: the first exact passage of each pair."""
        out = []
        for n in sorted({len(row) for row in self.short}):
            rows = np.array([row for row in self.short if len(row) == n])
            if n == 1:  # a word alone is no passage
                starts = begins[ends - begins == 1]
            else:
                starts = np.arange(len(flat) - n + 1)
            for k in range(n):
                member = np.zeros(self.n_symbols, dtype=bool)
                member[rows[:, k]] = True
                starts = starts[member[flat[starts + k]]]
            if not len(starts):
                continue
            read = np.column_stack([owner[starts], *(flat[starts + k] for k in range(n))])
            read, firsts = np.unique(read, axis=0, return_index=True)
            for (doc, *row), start in zip(read.tolist(), starts[firsts].tolist()):
                at = start - int(begins[doc])
                out += [(doc, key, 0, n, at, at + n) for key in self.short.get(tuple(row), ())]
        return out

    def symbols(self, text: str) -> np.ndarray:
        """The text's words as symbols."""
        words, known = latin_words(text), self.latin_ids
        if words is None:
            words, known = split_words(text), self.ids
        return np.fromiter(map(known.get, words, repeat(OTHER)), np.int32, len(words))

    def matches(self, texts: list[str]) -> list[tuple]:
        """(text, item key, edits, item words, begin word, end word), the best passage of each pair."""
        if not self.ids:
            return []
        ids = [self.symbols(text) for text in texts]
        if not any(map(len, ids)):
            return []
        flat, begins = joined(ids)
        ends = np.append(begins[1:], len(flat)) - 1  # where each text's end symbol stands
        owner = np.repeat(np.arange(len(ids)), ends - begins + 1)
        out = self.short_matches(flat, begins, ends, owner)
        if not self.words:
            return out
        limits = ends[owner]
        best: dict[tuple, tuple] = {}
        pairs = [p for p in self.candidates(flat, list(self.promising(flat, limits))) if len(p)]
        if pairs:
            starts, units = np.unique(np.concatenate(pairs), axis=0).T
            origin = self.owners[units]
            by_item = np.lexsort((starts, origin))
            starts, units, origin = starts[by_item], units[by_item], origin[by_item]
            found, firsts = np.unique(origin, return_index=True)
            for item, starts, units in zip(
                found.tolist(), np.split(starts, firsts[1:]), np.split(units, firsts[1:])
            ):
                own = self.item_words[item]
                edits = allowed_edits(len(own), self.share)
                # Where the item would begin; a window may be off its piece by the piece's edits.
                inner = len(own) > PIECE_WORDS
                slack = edits + (int(self.edits[units].max()) if inner else 0)
                heads = starts - self.offsets[units]
                if inner:
                    by_head = np.argsort(heads, kind="stable")
                    heads, starts = heads[by_head], starts[by_head]
                member = np.zeros(self.n_symbols, dtype=bool)
                member[own] = True
                lo = np.maximum(heads - slack, begins[owner[starts]])
                hi = np.minimum(heads + len(own) + slack, limits[starts])
                width = len(own) + 2 * slack
                at = lo[:, None] + np.arange(width)
                shared = (member[flat[np.minimum(at, len(flat) - 1)]] & (at < hi[:, None])).sum(axis=1)
                good = shared >= len(own) - edits
                exact = good & (heads >= begins[owner[starts]])
                inside = heads[exact, None] + np.arange(len(own))
                exact[exact] = (flat[np.minimum(inside, len(flat) - 1)] == own).all(axis=1)
                for a, doc in zip(heads[exact].tolist(), owner[starts[exact]].tolist()):
                    place = (0, a - int(begins[doc]), a - int(begins[doc]) + len(own))
                    best[doc, item] = min(place, best.get((doc, item), place))
                # A text that holds the item itself has its closest passage already.
                done = np.isin(owner[starts], owner[starts[exact]])
                good &= ~done
                for a, b in _merged(lo[good], hi[good], owner):
                    doc = int(owner[a])
                    cost, begin, end = banded_distances(own, flat[a:b])
                    if cost <= edits:
                        place = (cost, a + begin - int(begins[doc]), a + end - int(begins[doc]))
                        if best.get((doc, item), place) >= place:
                            best[doc, item] = place
        for (doc, item), (cost, begin, end) in sorted(best.items()):
            out.append((doc, self.keys[item], cost, len(self.item_words[item]), begin, end))
        return out


def _merged(lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """Overlapping stretches of one text as one; ``lo`` ascends."""
    if not len(lo):
        return
    apart = (lo[1:] >= hi[:-1]) | (owner[lo[1:]] != owner[lo[:-1]])
    first = np.flatnonzero(np.concatenate([[True], apart]))
    yield from zip(lo[first].tolist(), np.maximum.reduceat(hi, first).tolist())


def _portions(texts: Iterable[str], most_chars: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    part, total, at = [], 0, 0
    for t in texts:
        part.append(t)
        total += len(part[-1])
        if total >= most_chars:
            yield at, part
            at, part, total = at + len(part), [], 0
    if part:
        yield at, part


def _match(shared, id_type: pa.DataType, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = shared.value
        for batch in batches:
            ids = batch.column(0)
            for at, texts in _portions(texts_of(batch.column(1))):
                hits = chunk.matches(texts)
                columns = list(zip(*hits)) or [()] * 6
                own = ids.take(pa.array([at + k for k in columns[0]], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(columns[1], item_type)]
                    + [pa.array(c, pa.int64()) for c in columns[2:]],
                    ["doc_id", "item_id", "edits", "item_words", "begin_word", "end_word"],
                )

    return run


def item_chunks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple]]:
    """The items in chunks of at most ``CHUNK_BYTES`` (a longer item is a chunk itself)."""
    rows = benchmark.select(F.col(item_column), F.col(text_column).cast("string")).where(
        F.col(text_column).isNotNull()
    )
    part, total = [], 0
    for row in rows.orderBy(item_column, text_column).toLocalIterator():
        size = len(row[1].encode())
        if part and total + size > CHUNK_BYTES:
            yield part
            part, total = [], 0
        part.append((row[0], row[1]))
        total += size
    if part:
        yield part


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    share: float = EDIT_SHARE,
    recall: float = RECALL,
) -> DataFrame:
    """One row per document and item that it leaks, with the closest passage.

    ``edits`` of ``item_words`` words, from ``begin_word`` to before ``end_word``.  Exact
    passages are always found; of passages with as many edits as allowed, ``recall``.
    Items without words, or null, match nothing; an item of fewer than five words is
    found as an exact passage, one of a single word only as a whole document.  In
    scripts written without spaces each letter counts as a word.  Null and empty texts leak nothing.
    Null ids are returned as null; repeated rows and items each give their rows.  An
    empty benchmark gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    types = docs.schema[id_column].dataType, benchmark.schema[item_column].dataType
    kinds, arrow = [t.simpleString() for t in types], [to_arrow_type(t) for t in types]
    schema = (
        f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long, item_words long, "
        "begin_word long, end_word long"
    )
    named = docs.select(id_column, F.col(text_column).cast("string"))
    found = None
    for items in item_chunks(benchmark, item_column, item_text_column):
        shared = spark.sparkContext.broadcast(Chunk(items, share, recall))
        part = named.mapInArrow(releasing(_match(shared, *arrow)), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found
