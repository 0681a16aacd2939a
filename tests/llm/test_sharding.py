import zlib
from collections import Counter

from lanecast.llm import sharding as S

from . import edge


def check(rows, found, shards):
    sizes = Counter(r["shard"] for r in found)
    counts = [sizes.get(k, 0) for k in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(sizes[k]))
    want = sorted(
        (str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == want
    assert {r["law"] for r in found} <= {"rows"} and {r["grown_shard"] for r in found} <= {None}


def test_edge_rows(spark):
    check(edge.rows(), S.shard_documents(edge.docs(spark)).collect(), 40)
    check(edge.rows(), S.shard_documents(edge.docs(spark), shards=3).collect(), 3)


def test_groups_stay_whole_and_counts_even(spark):
    rows = [(k, f"text {k // 3}" if k < 300 else f"own {k}", "en", "a", 1, *edge.EXTRA) for k in range(900)]
    found = S.shard_documents(spark.createDataFrame(rows, edge.DOCS), shards=9).collect()
    check(rows, found, 9)
    where = {}
    for r in found:
        if r["doc_id"] < 300:
            where.setdefault(r["doc_id"] // 3, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 3


def test_a_group_larger_than_a_shard_fills_some(spark):
    rows = [(k, "same" if k < 300 else f"own {k}", "en", "a", 1, *edge.EXTRA) for k in range(900)]
    found = S.shard_documents(spark.createDataFrame(rows, edge.DOCS), shards=9).collect()
    check(rows, found, 9)
    assert len({r["shard"] for r in found if r["doc_id"] < 300}) <= 5


def test_a_third_of_the_rows_as_one_group(spark):
    rows = [(k, "same" if k < 800 else f"own {k}", "en", "a", 1, *edge.EXTRA) for k in range(2400)]
    found = S.shard_documents(spark.createDataFrame(rows, edge.DOCS)).collect()
    check(rows, found, 40)
    assert len({r["shard"] for r in found if r["doc_id"] < 800}) == 14


def test_members_leave_full_shards(spark):
    def placed(state, shards):
        nodes = spark.createDataFrame(state, "row long, group string, shard int")
        number = 0
        while (moved := S._round(nodes, shards, 1, number)) is not None:
            nodes, number = S.freeze(moved, "shards"), number + 1
        rows = nodes.collect()
        assert Counter(r["shard"] for r in rows) == Counter(s for _, _, s in state)
        return {g: sorted(r["shard"] for r in rows if r["group"] == g) for g in "ab"}

    # Shard 0 is full: a pair is cut between it and the open shard 1.
    state = [(0, "a", 0), (1, "b", 0), (2, "b", 0), (3, "a", 1), (4, None, 1), (5, None, 1)]
    assert placed(state, 2) == {"a": [1, 1], "b": [0, 0]}
    # The full shard holds more of the group than the open one.
    state = [(0, "a", 0), (1, "a", 0), (2, "b", 0), (3, "b", 0), (4, "a", 1), (5, None, 1), (6, None, 1), (7, None, 1)]
    assert placed(state, 2) == {"a": [1, 1, 1], "b": [0, 0]}
    # Both shards of the pair are full, a third one is open.
    state = [(0, "a", 0), (1, "b", 0), (2, "a", 1), (3, "b", 1), (4, None, 2), (5, None, 2)]
    assert [0, 1] not in placed(state, 3).values()


def test_numbers_have_no_gaps_across_slices(spark):
    rows = spark.range(1000).selectExpr("id AS row", "id % 3 AS g")
    found = S.numbered(rows, ["g"], S._mixed(S.F.col("row")), 7, "k").collect()
    for g in range(3):
        own = sorted(r["k"] for r in found if r["g"] == g)
        assert own == list(range(len(own)))


def test_numbering_shuffles_rows_once_and_counts_once(spark, monkeypatch, capsys):
    rows = spark.range(1000).selectExpr("id AS row", "id % 3 AS g")

    def numbers(few):
        return S.numbered(rows, ["g"], S._mixed(S.F.col("row")), 7, "k", few)

    numbers(True).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
    want = sorted(map(tuple, numbers(True).collect()))
    assert sorted(map(tuple, numbers(False).collect())) == want
    monkeypatch.setattr(S, "COUNTED_SLICES", 0)
    assert sorted(map(tuple, numbers(True).collect())) == want


def test_no_rows(spark):
    assert S.shard_documents(edge.none(spark)).collect() == []
