"""The pipeline's stages on small rows, each against what its operator says of its own input."""

import pytest

import corpus_pipeline as C
import public_tokenizers
from lanecast.llm import simhash, toxicity
from lanecast.llm.tokens import Encoder

from . import edge

MARK = "vilescum"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, labels = edge.rows(), []
    for k in range(300):
        words = edge.prose(90, 1000 + 17 * k).split()
        words = [f"{w}{k}" if j % 4 == 0 else w for j, w in enumerate(words)]
        if k % 3 == 0:
            for j in range(0, len(words), 9):
                words[j] = MARK
        rows.append((1000 + k, " ".join(words), "en", "abc"[k % 3], 1, *edge.EXTRA))
        labels.append((1000 + k, 1, int(k % 3 == 0)))
    leak = " ".join(f"leak{j}" for j in range(30))
    rows.append((5000, edge.prose(60, 77) + " " + leak + " " + edge.prose(50, 78), "en", "a", 1, *edge.EXTRA))
    spark.createDataFrame(rows, edge.DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found, at = {}, tmp_path_factory.mktemp("stages")
    small = toxicity.Settings(steps=250, batch=64)
    fit = C.fit
    C.fit = lambda docs, labels, learn: fit(docs, labels, learn, small)
    try:
        for name, stage in C.STAGES:
            stage(spark, docs, folder).write.parquet(f"{at}/{name}")
            out = spark.read.parquet(f"{at}/{name}")
            found[name] = docs.collect(), out.collect(), out.columns
            docs = out
    finally:
        C.fit = fit
    return found


def test_columns_stay(stages):
    first = [f.split()[0] for f in edge.DOCS.split(", ")]
    for name, _ in C.STAGES[:-1]:
        assert stages[name][2] == first


def test_toxic_documents_go(stages):
    before, after, _ = stages["toxicity"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    toxic = {r["doc_id"] for r in before if MARK in (r["text"] or "")}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 3


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages["simhash_near_dedup"]
    prints = [simhash.fingerprint(r["text"]) & (1 << 64) - 1 for r in before]
    comp = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    assert len(after) == len(set(comp))
    kept = [simhash.fingerprint(r["text"]) & (1 << 64) - 1 for r in after]
    group = {p: c for p, c in zip(prints, comp)}
    assert {group[p] for p in kept} == set(comp)


def test_leaks_go_and_nothing_else(stages):
    before, after, _ = stages["benchmark_decontamination"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {5000}
    assert len(before) - len(after) == 1


def test_mix_repeats_documents(stages):
    before, after, _ = stages["mix_sources"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    times = {}
    for r in after:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    total = sum(len((r["text"] or "").split()) for r in before)
    mixed = sum(len((r["text"] or "").split()) for r in after)
    longest = max(len((r["text"] or "").split()) for r in before)
    assert abs(total - mixed) <= 4 * longest


def test_files_hold_the_mix(stages):
    before, after, _ = stages["token_output"]
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r["doc_id"]), len(encoder.encode([r["text"] or ""])[0]) // 2 + 1) for r in before)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in after) == want


def test_no_rows(spark, folder, tmp_path):
    docs = spark.createDataFrame([], edge.DOCS)
    for name, stage in C.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_columns_named_like_helpers_pass_through_the_mix(spark):
    rows = [(k, edge.prose(20 + k % 5, k), "en", "ab"[k % 2], 0, 7, 8, 9, 10, 11) for k in range(40)]
    rows += [(None, edge.prose(12, 3), "en", "a", 0, 7, 8, 9, 10, 11)] * 30  # null ids of one size
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, taken_words long, "
        "taken_size long, taken_copies long, taken_copy long, `taken.number` long"
    )
    docs = spark.createDataFrame(rows, schema)
    found = C.mix_sources(spark, docs, "")
    assert found.columns == docs.columns
    got = found.collect()
    assert len(got) >= 40 and {tuple(r)[5:] for r in got} == {(7, 8, 9, 10, 11)}
    known = {tuple(r) for r in rows}
    assert all(tuple(r) in known for r in got)
