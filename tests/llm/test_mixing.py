import re

from lanecast.llm import mixing as M

from . import edge


def slow_targets(sizes):
    """Share by weight, stop at three times, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        open_ = sum(weight[s] for s in names if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else left * weight[s] / open_ for s in names}
        above = {s for s in names if s not in stopped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        stopped |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, found, most_off):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    target = slow_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted(
        (str(r[0]), words(r[1])) for r in rows
    )
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        if r["size"]:
            assert int(rate + 1e-9) <= r["copies"] <= int(rate + 1e-9) + 1
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most_off(s)


def test_edge_rows(spark):
    rows = edge.rows()
    found = M.mix(edge.docs(spark)).collect()
    longest = {}
    for r in rows:
        longest[r[3]] = max(longest.get(r[3], 0), words(r[1]))
    check(rows, found, lambda s: longest[s])


def test_targets_are_met_within_one_document_and_reruns_agree(spark):
    rows = []
    for k in range(3000):  # one source holds two thirds of the rows
        source = "hot" if k % 3 else f"s{k % 7}"
        rows.append((k, " ".join(["w"] * (1 + k * k % 90)), "en", source, 1, *edge.EXTRA))
    docs = spark.createDataFrame(rows, edge.DOCS)
    found = M.mix(docs).collect()
    check(rows, found, lambda s: 90)
    again = M.mix(docs.repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_stopped_sources_pass_their_excess_on(spark):
    rows = [(k, "a b c d", "en", s, 1, *edge.EXTRA) for k, s in enumerate(["x"] * 1 + ["y"] * 200 + ["z"] * 2)]
    found = M.mix(spark.createDataFrame(rows, edge.DOCS)).collect()
    check(rows, found, lambda s: 4)
    assert {r["copies"] for r in found if r["source"] in "xz"} == {3}


def test_many_levels(spark, monkeypatch):
    monkeypatch.setattr(M.pivotal_rounding, "__defaults__", (4,))
    rows = [(k, " ".join("w" * (1 + k % 9)), "en", "ab"[k % 2], 1, *edge.EXTRA) for k in range(400)]
    check(rows, M.mix(spark.createDataFrame(rows, edge.DOCS)).collect(), lambda s: 9)


def test_no_python_in_the_plan(spark, capsys):
    M.mix(edge.docs(spark)).explain()
    assert "Python" not in capsys.readouterr().out


def test_no_rows(spark):
    assert M.mix(edge.none(spark)).collect() == []


def test_repeated_rows_get_as_many_buckets_as_they_need(spark, monkeypatch):
    largest, fold = [], M._fold

    def counted(docs, seed):
        largest.append(docs.groupBy("source", "bucket").count().agg(M.F.max("count")).first()[0] or 0)
        return fold(docs, seed)

    monkeypatch.setattr(M, "_fold", counted)
    n = 20 * M.FAN
    docs = spark.range(n).selectExpr("1L AS doc_id", "'one two three' AS text", "'a' AS source")
    docs = docs.unionByName(spark.range(900).selectExpr("id + 2 AS doc_id", "'one two' AS text", "'b' AS source"))
    found = M.mix(docs).where("source = 'a'").collect()
    assert len(found) == n
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 3
    assert max(largest) <= 2 * M.FAN
