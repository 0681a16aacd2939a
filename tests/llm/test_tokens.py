import zlib

import numpy as np
import pytest
import zstandard

import public_tokenizers
from lanecast.llm import tokens as T

from . import edge

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library_on_whole_texts(name):
    encoder = T.Encoder(public_tokenizers.path(name))
    texts = [
        "", "a b", "a  b", "a\nb c", " a", "a ", "a\t b", "x\n\ny z", "foo \nbar", "foo\n bar", "a   b",
        "don't we'll I've", "1 2,3 .. ..a", "<|endoftext|> a", "a <|endoftext|>b", "é, ü. b", "a　b", "日本 語!",
        "end. End, end; (x) \"q\" 50% a_b a-b", "stop.. stop, ,stop é. ß, naïve.", edge.prose(500),
    ]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    want = [np.array(e.ids, dtype=encoder.type).tobytes() for e in whole]
    assert encoder.encode(texts) == want
    assert encoder.encode(texts) == want  # from the cache


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "CACHED_WORDS", 3)
    texts = [edge.prose(200, k) for k in range(4)]
    encoder = T.Encoder(PATH)
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.array(e.ids, dtype="<u2").tobytes() for e in whole]


def test_words_met_before_are_not_merged_again():
    """Words on both sides of a line break, and letters before marks, are known on their own."""
    encoder = T.Encoder(PATH)
    merged, merge = [], encoder.merge
    encoder.merge = lambda shown: merged.append(shown) or merge(shown)
    encoder.encode(["one fifteen\nTwenty two", "one thirty\nForty two", "a seventy%% b", "a ninety!?; b"])
    merged.clear()
    texts = ["one fifteen\nForty two", "one thirty\nTwenty ninety!?;", "a seventy%%"]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    want = [np.array(e.ids, dtype=encoder.type).tobytes() for e in whole]
    assert encoder.encode(texts) == want
    assert merged == []
    texts = ["\nninety", "ninety\n", "a \nb", "a\n b", "a\n\nb", "\n", " ", "x\u2028y z", "ninety\x1c a", "a's'!! b'%"]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.array(e.ids, dtype=encoder.type).tobytes() for e in whole]


def slow_digests(rows):
    encoder = T.Encoder(PATH)
    found = []
    for r in rows:
        ids = encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        found.append((r[0], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    return found


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_round_trip(spark, tmp_path, monkeypatch, block):
    rows = edge.rows() + [(100 + k, edge.prose(200, k), "en", "a", 1, *edge.EXTRA) for k in range(60)]
    folder = str(tmp_path / "out")
    monkeypatch.setattr(T, "BLOCK_BYTES", block)
    T.write_tokens(spark.createDataFrame(rows, edge.DOCS).repartition(4), folder, PATH, 2)
    found = T.read_digests(spark, folder).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == sorted(
        (str(i), n, c) for i, n, c in slow_digests(rows)
    )
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert order == sorted(order)
    (own,) = T.read_document(spark, folder, 107)
    encoder = T.Encoder(PATH)
    assert own.tolist() == encoder.tokenizer.encode(edge.prose(200, 7), add_special_tokens=False).ids + [2]
    assert len(T.read_document(spark, folder, 2)) == 2
    assert len(T.read_document(spark, folder, None)) == 2
    assert T.read_document(spark, folder, 12345) == []


def test_other_dictionary_is_refused(spark, tmp_path):
    rows = [(k, edge.prose(300, k), "en", "a", 1, *edge.EXTRA) for k in range(80)]
    folder = str(tmp_path / "out")
    T.write_tokens(spark.createDataFrame(rows, edge.DOCS), folder, PATH, 2)
    found = T._read_dictionary(spark, folder)
    assert found["data"]
    with pytest.raises(ValueError):
        T._unpacker(found, "another")


def test_no_rows(spark, tmp_path):
    folder = str(tmp_path / "out")
    T.write_tokens(edge.none(spark), folder, PATH, 2)
    assert T.read_digests(spark, folder).collect() == []


def test_dictionary_learns_from_anywhere_in_long_texts(spark, monkeypatch):
    """Of texts that start alike, a sample of beginnings would hold a single piece."""
    monkeypatch.setattr(T, "SAMPLE_CHARS", 2000)
    rng = np.random.default_rng(3)
    start = "the same words at the start " * 80
    texts = [start + " ".join(rng.choice(edge.WORDS, 800)) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = T.train_dictionary(docs, "text", PATH, 2)
    again = T.train_dictionary(docs.repartition(5), "text", PATH, 2)
    assert found["data"] and found["hash"] == again["hash"]
    body = " ".join(rng.choice(edge.WORDS, 60)).split(" ")
    ids = T.encoder(PATH).encode([" ".join(body)])[0]
    plain = zstandard.ZstdCompressor().compress(ids)
    with_it = zstandard.ZstdCompressor(dict_data=T._dictionary(found["data"])).compress(ids)
    assert len(with_it) < len(plain)


def test_texts_leave_a_batch_in_parts():
    import pyarrow as pa

    from lanecast.llm.tables import texts_of

    column = pa.array([None if k % 7 == 0 else f"t{k}" for k in range(25)])
    assert list(texts_of(column, rows=4)) == [t or "" for t in column.to_pylist()]
    assert list(texts_of(column.slice(3, 5))) == ["t3", "t4", "t5", "t6", ""]
    assert list(T._batches(texts_of(column, rows=4), most=30)) == list(
        T._batches([t or "" for t in column.to_pylist()], most=30)
    )
