import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanecast.llm import packing as P
from lanecast.llm import queries

from . import edge

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


ODD = st.sampled_from(
    ["́", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "don't", "It's.", "Ärger,",
     "ΣΑΣ.", "12.5", "语言", "한국", "İ", "ß!", "<|endoftext|>", "<|startoftext|>x", "a.b", "...", "word.", "ẞ?",
     "ǅ,", "\U0001f600", "'s", "x's", "ﬁ."]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=6)), max_size=12))
def test_words_give_the_librarys_ids(parts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH) if not hasattr(test_words_give_the_librarys_ids, "t") else None
    if whole is not None:
        test_words_give_the_librarys_ids.t = whole
    text = "".join(parts).encode("utf-8", "ignore").decode()
    encoder = P.word_encoder(PATH)
    assert encoder.by_word
    want = test_words_give_the_librarys_ids.t.encode(text, add_special_tokens=False).ids
    for _ in range(2):  # as new words, then from the cache
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == want


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 3)
    small, large = P.WordEncoder(PATH), P.word_encoder(PATH)
    texts = ["One two, three four.", "", "five six seven " + "x" * 200, "One two, three"]
    for _ in range(2):
        assert small.encode(texts) == large.encode(texts)


def test_letters_and_marks_need_no_call_of_the_whole_pipeline(library):
    encoder = P.WordEncoder(PATH)
    texts = ["Plain letters, in sentences.\nÄrger (und) Ñandú%% mixed!!", "plain LETTERS!? Sentences"]
    want = [library(t)[:-1] for t in texts]
    whole, seen = encoder._whole, []
    encoder._whole = lambda words: seen.extend(words) or whole(words)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == want
    assert all(not any(map(str.isalpha, w)) for w in seen if w != "(und)")
    known = len(encoder.known)
    encoder.encode(["PLAIN LETTERS, IN Sentences."])
    assert len(encoder.known) == known  # plain texts are lowered before they are cut
    odd = ["a <|ENDOFTEXT|> B", "a<|EndOfText|>b <|endoftext|>", "A<|startoftext|>B C"]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(odd)] == [library(t)[:-1] for t in odd]


def test_other_tokenizers_see_whole_texts():
    other = P.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    ids = other.tokenizer.encode(" two words ", add_special_tokens=False).ids
    assert np.frombuffer(other.encode([" two words "])[0], other.type).tolist() == ids


def slow_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.just(50))
def test_best_fit_equals_the_plain_rule(sizes, capacity):
    bins, places, fills = P.best_fit(np.array(sizes, np.int64), capacity)
    assert sorted(capacity - fills) == slow_best_fit(sizes, capacity)
    gapless(zip(bins.tolist(), places.tolist(), sizes), capacity)


def gapless(rows, capacity):
    """Pieces of a sequence follow each other without a gap, up to the capacity; number of sequences."""
    found = defaultdict(list)
    for sequence, offset, length in rows:
        found[sequence].append((offset, length))
    for own in found.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


def check(rows, found, library, capacity=2048):
    want = []
    for doc_id, text in rows:
        ids = library(text)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)
    return gapless([(r["sequence_id"], r["offset"], r["length"]) for r in found], capacity)


def test_edge_rows(spark, library):
    rows = [(r[0], r[1]) for r in edge.rows()]
    found = P.packed_documents(edge.docs(spark), PATH, 0).collect()
    n = check(rows, found, library)
    total = sum(r["length"] for r in found)
    assert n == -(-total // 2048)
    assert P.packed_documents(edge.none(spark), PATH, 0).collect() == []


def pieces(spark, sizes, parts=6):
    rows = [(k, k, 0, 0, s, 0) for k, s in enumerate(sizes)]
    schema = "row long, doc_id long, piece int, start long, length long, bin long"
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.mark.parametrize("group", [40, 500, 200_000])
def test_rounds_keep_every_piece_and_waste_little(spark, group):
    rng = random.Random(group)
    sizes = [min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(3000)]
    found = P.pack(pieces(spark, sizes), group=group).collect()
    assert sorted((r["row"], r["length"]) for r in found) == list(enumerate(sizes))
    n = gapless([(r["sequence_id"], r["offset"], r["length"]) for r in found], 2048)
    assert n <= -(-sum(sizes) // 2048) * 1.02 + 1


@pytest.mark.parametrize("size", [2048, 1100, 1024, 1])
def test_equal_lengths(spark, size):
    """Pieces that never fit together end after a round; those that do fill their sequences."""
    sizes = [size] * 3000
    found = P.pack(pieces(spark, sizes), group=300).collect()
    n = gapless([(r["sequence_id"], r["offset"], r["length"]) for r in found], 2048)
    best = -(-3000 // (2048 // size))
    assert len(found) == 3000 and best <= n <= best + 12


def test_sequences_hold_the_ids(spark, library):
    docs = edge.docs(spark)
    written = P.token_pieces(docs, PATH, 0, capacity=100)
    packed = P.pack(written, 100)
    for r in P.sequences(written, packed).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        assert len(ids) == r["n_tokens"] == sum(p["length"] for p in r["parts"]) <= 100
    total = sum(len(library(r[1])) for r in edge.rows())
    assert sum(r["n_tokens"] for r in P.sequences(written, packed).collect()) == total


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.01"
    found = queries.op12_best_fit_packing(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    n = check([tuple(r) for r in docs], found, library)
    total = sum(r["length"] for r in found)
    assert n <= -(-total // 2048) * 1.01 + 1, (n, total / 2048)
