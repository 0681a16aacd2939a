"""Documents packed into training sequences of bounded length by hierarchical best fit.

Texts become token ids with an end id; only documents longer than a sequence are cut.
The pieces, ids included, are written once as a Parquet table; packing reads their
lengths only.

Every task packs the pieces of its partition by best fit, longest first: a piece goes
into the open bin that it fills best, else into a new one.  A bin that not even the least
filled bin would still fit into is finished and leaves.  The others are items of the
next round: dealt to groups of bounded size and packed by best fit again, as wholes,
until one group is left or a round merges next to nothing.  A merged bin keeps the name of
its first part, so a round is a list of moves (bin, into, shift); moves of all rounds are
composed, and one join with that short list gives every piece its sequence and place.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import freeze, importable
from .tokens import _ID, MARKS, _visible_bytes

CAPACITY = 2048
GROUP = 200_000  # items that one task packs together
LEAST_MERGED = 1e-3  # a round that merges a smaller share of its bins is the last
CACHED_WORDS = 700_000  # in a Python worker; when full, further words aren't kept
CACHED_LENGTH = 64
PORTION = 4 << 20  # characters encoded at once

# Fixed value.
_OLD_LETTERS = "ɐ"  # letters below were never anything else in any Unicode version


class WordEncoder:
    """Ids by the tokenizers library, which sees a word once per worker.

    A vocabulary whose pieces never cross white space gives a text the ids of its words,
    one after another.  ``by_word`` tells whether the tokenizer is of that kind: it cuts
    by a pattern that drops white space.  Texts are cut at spaces and line breaks only;
    other white space stays inside a word and is the library's business.  A word of letters is
    one piece, which the library's model merges.  Where the tokenizer lowers cases, plain texts
    are lowered first, so that fewer words are new.  Texts of other tokenizers are encoded in
    one piece.
    """

    def __init__(self, path: str):
        # One process per core is Spark's business; the library must not add threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        # Letters and marks after them hold no special token's string.
        bodies = [s.rstrip(MARKS) for s in self.special]
        self.by_word = self._drops_space(settings) and not any(b.isalpha() or not b for b in bodies)
        self.lowers = self.by_word and self._composes_and_lowers(settings)
        self.merge = self.tokenizer.model.tokenize
        self.visible = _visible_bytes()
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _drops_space(settings: dict) -> bool:
        steps = settings.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps])
        first, rest = steps[0], steps[1:]
        kept = first.get("pattern", {}).get("Regex", "")
        return (
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and bool(first.get("invert"))
            # Alternatives are letters, single digits, short forms, or exclude white space.
            and kept == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") for s in rest)
        )

    @staticmethod
    def _composes_and_lowers(settings: dict) -> bool:
        """Whether the normalizer changes nothing in ASCII words but their case."""
        steps = (settings.get("normalizer") or {}).get("normalizers", [])
        spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        return steps == [{"type": "NFC"}, spaces, {"type": "Lowercase"}]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.type).tobytes() for e in found]

    def _letters(self, word: str) -> bytes | None:
        """The ids of a word that is a single piece for certain."""
        if self.lowers and word.isalpha() and max(word) < _OLD_LETTERS:
            word = word.lower()
            if word.isalpha():  # a letter may be lowered to two characters
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.visible)
                ids = list(map(_ID, self.merge(shown)))
                return struct.pack(f"<{len(ids)}{self.code}", *ids)
        return None

    def _new(self, word: str) -> bytes:
        """Ids of a new word, kept if it may be met again."""
        known = self.known
        body = word.rstrip(MARKS)
        if body != word and body.isalpha() and max(body) < _OLD_LETTERS:  # letters, then marks: two pieces
            end = word[len(body) :]
            ids = (known.get(body) or self._new(body)) + (known.get(end) or self._new(end))
        else:
            ids = self._letters(word) or self._whole([word])[0]
        if len(word) <= CACHED_LENGTH and len(known) < CACHED_WORDS:
            known[word] = ids
        return ids

    def _lowered(self, text: str) -> str:
        if not self.lowers or not text.isascii():
            return text
        lowered = text.lower()
        # A special token's string is the same only as it stands.
        return text if any(s.lower() in lowered for s in self.special) else lowered

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        known, out = self.known, []
        for text in texts:
            words = self._lowered(text).replace("\n", " ").split(" ")
            ids = list(map(known.get, words))
            if None in ids:
                for k, found in enumerate(ids):
                    if found is None:
                        ids[k] = self._new(words[k])
            out.append(b"".join(ids))
        return out


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of some megabytes; null counts as empty."""
    first, part, size = 0, [], 0
    for k in range(len(texts)):
        part.append(texts[k].as_py() or "")
        size += len(part[-1])
        if size >= PORTION:
            yield first, part
            first, part, size = k + 1, [], 0
    if part:
        yield first, part


def _cut(tokenizer: str, end_id: int, capacity: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = word_encoder(tokenizer)
        end = np.array([end_id], dtype=found.type).tobytes()
        width = found.type.itemsize
        for batch in batches:
            for first, texts in _portions(batch.column("text")):
                owner, piece, length, crc, ids = [], [], [], [], []
                for k, own in enumerate(found.encode(texts)):
                    own += end
                    for number, at in enumerate(range(0, len(own), capacity * width)):
                        part = own[at : at + capacity * width]
                        owner.append(first + k)
                        piece.append(number)
                        length.append(len(part) // width)
                        wide = part if width == 4 else np.frombuffer(part, found.type).astype("<u4")
                        crc.append(zlib.crc32(wide))
                        ids.append(part)
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(at),
                        batch.column("doc_id").take(at).cast(id_type),
                        pa.array(piece, pa.int32()),
                        pa.array(np.array(piece, np.int64) * capacity),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Every document's ids and the end id in pieces of at most ``capacity``, written once.

    Columns: ``row`` (tells documents of equal id apart), ``doc_id``, ``piece``, ``start``,
    ``length``, ``ids_crc32`` (of the ids as 32-bit integers) and ``ids``, little-endian
    unsigned integers of 16 bits where the vocabulary fits, else 32.
    """
    importable(docs.sparkSession)
    kind = docs.schema[id_column].dataType
    named = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("doc_id"),
        F.col(text_column).cast("string").alias("text"),
    )
    pieces = named.mapInArrow(
        _cut(tokenizer, end_id, capacity, to_arrow_type(kind)),
        f"row long, doc_id {kind.simpleString()}, piece int, start long, length long, "
        "ids_crc32 long, ids binary",
    )
    return freeze(pieces, "token-pieces")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per item its bin and its place there, and the fill of every bin.

    Longest first; an item goes into the bin whose room exceeds it least.  Bins stand in
    stacks by their room; the bits of one number tell which stacks hold any.
    """
    bins = np.empty(len(sizes), np.int64)
    places = np.empty(len(sizes), np.int64)
    room_of: list[int] = []
    stacks: dict[int, list[int]] = {}
    mask = 0
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = stacks[room]
            own = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            room, own = capacity, len(room_of)
            room_of.append(capacity)
        bins[item], places[item] = own, capacity - room
        room -= size
        room_of[own] = room
        if room:
            stacks.setdefault(room, []).append(own)
            mask |= 1 << room
    return bins, places, capacity - np.array(room_of, np.int64)


def _tables(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of at most about ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _pack_locally(capacity: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36  # of this task's bins
        for t in _tables(batches, group):
            bins, places, fills = best_fit(t["length"].to_numpy(), capacity)
            t = t.append_column("bin", pa.array(first + bins))
            t = t.append_column("offset", pa.array(places))
            t = t.append_column("fill", pa.array(fills[bins]))
            first += len(fills)
            yield from t.to_batches()

    return run


def _merge(capacity: int, group: int):
    """Best fit of whole bins; a merged bin is named after its first part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tables(batches, group):
            names = t["bin"].to_numpy()
            bins, places, fills = best_fit(t["fill"].to_numpy(), capacity)
            heads = np.empty(len(fills), np.int64)
            lead = np.flatnonzero(places == 0)
            heads[bins[lead]] = names[lead]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(heads[bins]), pa.array(places), pa.array(fills[bins])],
                ["bin", "into", "shift", "fill"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` without their ids, with ``sequence_id`` and ``offset``.

    ``length`` must be between 1 and ``capacity``; other columns pass through, except that
    columns named ``bin``, ``fill``, ``into`` and ``shift`` are used up.  No rows give none.
    """
    own = pieces.drop("ids", "bin", "fill", "into", "shift", "sequence_id", "offset")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    local = own.mapInArrow(_pack_locally(capacity, group), f"{kinds}, bin long, offset long, fill long")
    placed = freeze(local, "packed-locally")
    bins = placed.where("offset = 0").select("bin", "fill")
    moves = None
    number = 0
    while True:
        least = bins.agg(F.min("fill")).first()[0]
        open_ = bins.where(capacity - F.col("fill") >= F.lit(least or 0))
        n = open_.count()
        if n < 2:
            break
        number += 1
        groups = math.ceil(n / group)
        dealt = open_.repartition(groups, F.xxhash64("bin", F.lit(number)))
        merged = freeze(
            dealt.mapInArrow(_merge(capacity, group), "bin long, into long, shift long, fill long"),
            f"merged-{number}",
        )
        bins = merged.where("bin = into").select("bin", "fill")
        moved = merged.where("bin <> into").select("bin", "into", "shift")
        gone = moved.count()
        if gone:
            if moves is not None:  # what moved before moves on with the bin it is in
                on = moved.select(
                    F.col("bin").alias("held"), F.col("into").alias("next"), F.col("shift").alias("more")
                )
                before = moves.join(on, F.col("into") == F.col("held"), "left").select(
                    "bin",
                    F.coalesce("next", "into").alias("into"),
                    (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
                )
                moved = before.union(moved)
            moves = freeze(moved, f"moves-{number}")
        if groups == 1 or gone < LEAST_MERGED * n:
            break
    columns = [F.col(f"`{c}`") for c in own.columns]
    if moves is None:
        return placed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    return placed.join(moves, "bin", "left").select(
        *columns,
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def sequences(pieces: DataFrame, packed: DataFrame, width: int = 2) -> DataFrame:
    """(sequence_id, n_tokens, ids, parts): every sequence with its ids as stored in ``pieces``.

    ``parts`` lists document, piece, offset and length in order, from which a trainer
    makes the attention mask.  ``width`` is the bytes of a stored id.  A sequence gathers at
    most ``capacity`` ids, so no group grows with the data.
    """
    placed = pieces.select("row", "piece", "ids").join(packed, ["row", "piece"])
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    grouped = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return grouped.select(
        "sequence_id",
        (F.length(joined) / width).cast("long").alias("n_tokens"),
        joined.alias("ids"),
        F.transform(
            "p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])
        ).alias("parts"),
    )


def packed_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the vocabulary's path, the same on every executor.  A null or empty
    text is the end id alone, a piece of length 1.  A text of any length is cut into pieces
    of ``capacity`` ids, the last one shorter.  Null and repeated ids are packed row by
    row (``row`` tells them apart).  Ties in length are broken by the rows' order in the
    written table, so sequence numbers may differ between layouts.  No rows give none.
    Columns other than the two named are not read.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_column, text_column)
    packed = pack(pieces, capacity)
    return packed.select(
        F.col("doc_id").alias(id_column),
        "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row",
    )
