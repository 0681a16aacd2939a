"""Token ids as compressed binary blocks with a shared dictionary and an offset index.

File format.  A data set is a Parquet folder, one row per block of about a megabyte:

``part, block``  position in ascending document order
``dictionary``   SHA-256 of the zstandard dictionary that the frames need
``payload``      the documents' zstandard frames, one after another
``docs``         per document: id, offset and length of its frame in ``payload``,
                 and its number of ids

and a second folder holds the one dictionary with its hash and the width of an id.
A frame decompresses on its own to the ids as little-endian unsigned integers of 16
bits where the vocabulary fits, else 32.  A reader that wants one document reads the
``docs`` column, then one payload, then one frame.  Blocks are written by Spark, so
they land in any store and a lost executor's files are written again.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import freeze, importable, releasing, texts_of

# Parameters: the dictionary is trained on at most so many documents and bytes of ids.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 8 << 20
SAMPLE_CHARS = 20_000  # of a sampled text, at a drawn place
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 1 << 20
LEVEL = 1
CACHED_WORDS = 900_000  # in a Python worker; when full, further words aren't kept

# Fixed value: how a byte-level vocabulary of this kind splits text before its merges.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPACE = "\u0120"  # a space in the byte-level alphabet
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # a run of them after letters is one piece
# White space beside the space and the line break.
ASCII_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
SPACES = ASCII_SPACES + "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def cut_words(text: str) -> list[str] | None:
    """The text cut at its spaces and before its line breaks, where it has no other white space.

    The first word counts as one after a break.  Words that are empty or a break alone
    tell of white space that is not between visible characters, or repeated.
    """
    if any(map(text.__contains__, ASCII_SPACES if text.isascii() else SPACES)):
        return None
    return ("\n" + text.replace("\n", " \n")).split(" ")


_ID = attrgetter("id")


def _visible_bytes() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    """Ids by the tokenizers library, whose merges see a word once per worker.

    A byte-level vocabulary splits text before each space, and on both sides of each line
    break, that stands between two visible characters, so a word's ids don't depend on its
    neighbours: texts are cut there, and the library's model merges the pieces of words that
    are new.  ``words`` holds the ids of a space and the word, for a word that begins with a
    line break those of the break and the rest.  Texts with other white space, or with a
    special token's string, are encoded in one piece; so are all texts of vocabularies that
    split in another way.
    """

    def __init__(self, path: str):
        # One process per core is Spark's business; the library must not add threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.merge = self.tokenizer.model.tokenize
        self.visible = _visible_bytes()
        split = self.tokenizer.pre_tokenizer
        self.by_word = (
            isinstance(self.tokenizer.model, models.BPE)
            and isinstance(split, pre_tokenizers.ByteLevel)
            and not split.add_prefix_space
            and split.use_regex
            and self.tokenizer.normalizer is None
        )
        self.line = self._piece("\n") if self.by_word else b""

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, dtype=self.type).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._merged(piece.encode().decode("latin-1").translate(self.visible))

    def _merged(self, shown: str) -> bytes:
        ids = list(map(_ID, self.merge(shown)))
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _letters(self, word: str, space: str) -> bytes:
        """The ids of a word of letters alone, which is one piece with the space before it."""
        return self._merged((space and SPACE) + word) if word.isascii() else self._piece(space + word)

    def _spaced(self, word: str, space: str) -> bytes:
        """The ids of a word and the space before it, if any; plain words need no further splitting."""
        if word.isalpha():
            return self._letters(word, space)
        body = word.rstrip(MARKS)
        if body.isalpha():
            ids, end = self.words.get(body) if space else None, word[len(body) :]
            return (ids or self._letters(body, space)) + (self.marks.get(end) or self._word(end))
        return self._word(space + word)

    def _new(self, word: str) -> bytes:
        ids = self.line + self._spaced(word[1:], "") if word[0] == "\n" else self._spaced(word, " ")
        if len(self.words) < CACHED_WORDS:
            self.words[word] = ids
        return ids

    def _word(self, word: str) -> bytes:
        out = []
        for piece in PIECES.findall(word):
            ids = self.marks.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) < 4 and len(self.marks) < CACHED_WORDS:
                    self.marks[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.words, []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            special = any(s in text for s in self.special)
            words = None if special or not self.by_word else cut_words(text)
            if words is None:
                out.append(self._whole(text))
                continue
            ids = list(map(known.get, words))
            if None in ids:
                missing = [k for k, found in enumerate(ids) if found is None]
                new = [words[k] for k in missing]
                if "" in new or "\n" in new:
                    out.append(self._whole(text))
                    continue
                for k, word in zip(missing, new):
                    ids[k] = self._new(word)
            out.append(b"".join(ids)[len(self.line) :])
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches(values: Iterable, most: int = 4 << 20) -> Iterator[list]:
    """Texts in portions of some megabytes."""
    part, total = [], 0
    for v in values:
        part.append(v)
        total += len(v)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def train_dictionary(docs: DataFrame, text_column: str, tokenizer: str, end_id: int) -> dict:
    """A zstandard dictionary from a bounded sample of documents, and its hash.

    The sample follows the hash of the whole texts, so it is the same for every layout of
    the table, and copies enter once.  Only rows below a hash bound, about twice the sample,
    leave the scan.  Of a text longer than ``SAMPLE_CHARS`` a piece of that length enters,
    at a place drawn by the hash.  Too few ids give no dictionary.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count()))
    bound = F.lit(min(int(share * 2.0**63), (1 << 63) - 1))
    rows = docs.select(text.alias("t")).where(F.shiftrightunsigned(F.xxhash64(text), 1) <= bound)
    rows = rows.withColumn("h", F.xxhash64("t"))
    places = F.greatest(F.char_length("t") - SAMPLE_CHARS, F.lit(0)) + 1
    piece = F.substring("t", (F.pmod("h", places) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    rows = rows.select("h", piece.alias("t")).groupBy("h").agg(F.min("t").alias("t")).orderBy("h")
    found = encoder(tokenizer)
    samples, total = [], 0
    for part in _batches([r["t"] for r in rows.limit(SAMPLE_DOCS).collect()]):
        for ids in found.encode(part):
            if total < SAMPLE_BYTES:
                samples.append(ids + np.array([end_id], dtype=found.type).tobytes())
                total += len(samples[-1])
    data = b""
    if len(samples) >= 16 and total >= 16 << 10:
        try:
            size = min(DICTIONARY_BYTES, total // 8)
            data = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # samples too alike or too short to learn from
            data = b""
    return {"data": data, "hash": hashlib.sha256(data).hexdigest(), "width": found.type.itemsize}


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _compress(tokenizer: str, end_id: int, dictionary: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(tokenizer)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary["data"]))
        end = np.array([end_id], dtype=found.type).tobytes()
        for batch in batches:
            at = 0
            for part in _batches(texts_of(batch.column("text"))):
                ids = [i + end for i in found.encode(part)]
                own = batch.column("doc_id").slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        own,
                        pa.array([packer.compress(i) for i in ids], pa.binary()),
                        pa.array([len(i) // found.type.itemsize for i in ids], pa.int64()),
                    ],
                    ["doc_id", "frame", "n_tokens"],
                )

    return run


_BLOCK = (
    "part int, block int, dictionary string, payload binary, "
    "docs array<struct<doc_id:{id},offset:bigint,length:bigint,n_tokens:bigint>>"
)


def _into_blocks(dictionary_hash: str, id_type: pa.DataType):
    entry = pa.struct(
        [("doc_id", id_type), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, payload, docs, size = 0, 0, [], [], 0

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([dictionary_hash]),
                    pa.array([b"".join(payload)], pa.binary()),
                    pa.array([docs], pa.list_(entry)),
                ],
                ["part", "block", "dictionary", "payload", "docs"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                docs.append(
                    {
                        "doc_id": row["doc_id"],
                        "offset": size,
                        "length": len(row["frame"]),
                        "n_tokens": row["n_tokens"],
                    }
                )
                payload.append(row["frame"])
                size += len(row["frame"])
                if size >= BLOCK_BYTES:
                    yield written()
                    block, payload, docs, size = block + 1, [], [], 0
        if docs:
            yield written()

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every whole text, append ``end_id``, and write blocks in ascending id order.

    ``tokenizer`` is the vocabulary's path, the same on every executor.  A null or
    empty text is the end id alone.  Null ids come first; repeated ids are kept and
    stand in the order of their compressed ids.  No rows give no blocks.  Columns
    other than the two named are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    dictionary = train_dictionary(docs, text_column, tokenizer, end_id)
    id_type = docs.schema[id_column].dataType.simpleString()
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    encoded = named.mapInArrow(
        releasing(_compress(tokenizer, end_id, dictionary)), f"doc_id {id_type}, frame binary, n_tokens long"
    )
    encoded = freeze(encoded, "frames")
    # A hot id is spread by the frame's hash.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("frame"), F.col("frame")]
    placed = encoded.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    placed = placed.select(F.spark_partition_id().alias("part"), "doc_id", "frame", "n_tokens")
    arrow_id = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    into_blocks = releasing(_into_blocks(dictionary["hash"], arrow_id))
    blocks = placed.mapInArrow(into_blocks, _BLOCK.format(id=id_type))
    blocks.write.parquet(f"{folder}/blocks")
    spark.createDataFrame(
        [(dictionary["hash"], bytearray(dictionary["data"]), dictionary["width"])],
        "dictionary string, data binary, width int",
    ).coalesce(1).write.parquet(f"{folder}/dictionary")


def _read_dictionary(spark: SparkSession, folder: str) -> dict:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    found = {"data": bytes(row["data"]), "hash": row["dictionary"], "width": row["width"]}
    if hashlib.sha256(found["data"]).hexdigest() != found["hash"]:
        raise ValueError(f"the dictionary in {folder} is damaged")
    return found


def _frames(payload: bytes, docs, dictionary: dict, unpacker) -> Iterator[np.ndarray]:
    kind = np.dtype(f"<u{dictionary['width']}")
    view = memoryview(payload)
    for d in docs:
        frame = view[d["offset"] : d["offset"] + d["length"]]
        yield np.frombuffer(unpacker.decompress(frame), dtype=kind)


def _unpacker(dictionary: dict, named: str) -> zstandard.ZstdDecompressor:
    if named != dictionary["hash"]:
        raise ValueError("a block needs another dictionary than the folder holds")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary["data"]))


def _digest(dictionary: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = None
        for batch in batches:
            id_type = batch.schema.field("docs").type.value_type.field("doc_id").type
            for row in batch.to_pylist():
                unpacker = unpacker or _unpacker(dictionary, row["dictionary"])
                ids = list(_frames(row["payload"], row["docs"], dictionary, unpacker))
                counts = np.array([len(i) for i in ids], dtype=np.int64)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array([d["doc_id"] for d in row["docs"]], id_type),
                        pa.array(np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    ],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    return run


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, ``start``, ``n_tokens`` and ``ids_crc32``.

    ``start`` counts the ids of all documents before: blocks are summed from the index
    alone, parts by one running sum over one row per part.
    """
    importable(spark)
    blocks = spark.read.parquet(f"{folder}/blocks")
    dictionary = _read_dictionary(spark, folder)
    total = F.aggregate("docs.n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    sizes = blocks.select("part", "block", total.alias("n"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(in_file), zero).alias("part_start"))
    starts = sizes.select(
        "part", "block", F.coalesce(F.sum("n").over(in_part), zero).alias("block_start")
    ).join(parts, "part")
    id_type = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    found = blocks.mapInArrow(
        releasing(_digest(dictionary)),
        f"part int, block int, doc_id {id_type}, inside long, n_tokens long, ids_crc32 long",
    )
    return found.join(starts, ["part", "block"]).select(
        "doc_id",
        (F.col("part_start") + F.col("block_start") + F.col("inside")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def read_document(spark: SparkSession, folder: str, doc_id) -> list[np.ndarray]:
    """The ids of one document (once for each row that has the id), by way of the index."""
    dictionary = _read_dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    hits = blocks.select("part", "block", F.explode("docs").alias("d")).where(
        F.col("d.doc_id").eqNullSafe(F.lit(doc_id))
    )
    places = hits.select("part", "block", "d").collect()
    found = []
    for place in places:
        at = (F.col("part") == place["part"]) & (F.col("block") == place["block"])
        # Only this frame's bytes leave the executors.
        frame = F.substring("payload", place["d"]["offset"] + 1, place["d"]["length"])
        row = blocks.where(at).select("dictionary", frame.alias("frame")).first()
        unpacker = _unpacker(dictionary, row["dictionary"])
        kind = np.dtype(f"<u{dictionary['width']}")
        found.append(np.frombuffer(unpacker.decompress(bytes(row["frame"])), dtype=kind))
    return found
