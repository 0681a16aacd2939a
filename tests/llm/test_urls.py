import pytest
from pyspark.sql import functions as F

from lanecast.llm import urls as U

PAGES = "page_id long, url string, html string, host string, path long, rule string, tokens string, fixed int"
X = ("h", "z", 1, "r", "t", 1)

CASES = [
    ("http://a.com/x", "a.com", "/x", "com/", "allow"),
    ("https://Blog.Example.COM/en/5?q=1#f", "blog.example.com", "/en/5", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://www.example.com/EN/", "www.example.com", "/EN/", "com/", "allow"),
    ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://net/es/", "net", "/es/", "net/es/", "block"),
    ("http://a.net/fr/1", "a.net", "/fr/1", "net/fr/", "block"),
    ("http://a.net/fr", "a.net", "/fr", None, None),
    ("http://a.com", "a.com", "", None, None),
    ("http://a.com?x=/en/", "a.com", "", None, None),
    ("http://a.com#x/y", "a.com", "", None, None),
    ("a.com/x", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("x://y://z/w", "y:", "//z/w", None, None),
    ("://", "", "", None, None),
    ("http:///p", "", "/p", None, None),
    ("http://ÄB.net/es/ü", "Äb.net", "/es/ü", "net/es/", "block"),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(k, c[0], *X) for k, c in enumerate(CASES)]
    rows += [(100 + k, f"http://s{k % 5}.org/en/{k}", *X) for k in range(40)]
    rows += [(None, "http://q.net/de/1", *X)] * 2
    return U.judge_urls(spark.createDataFrame(rows, PAGES).repartition(3)).collect()


def test_hosts_paths_and_fixed_rules(judged):
    by_id = {r["page_id"]: r for r in judged if r["page_id"] is not None}
    for k, (url, host, path, rule, verdict) in enumerate(CASES):
        r = by_id[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert len(judged) == len(CASES) + 42


def slow_rules(labelled):
    """All sets of up to three tokens with their support and confidence."""
    from itertools import combinations

    count, hits = {}, {}
    for tokens, verdict in labelled:
        for n in (1, 2, 3):
            for own in combinations(sorted(tokens), n):
                count[own] = count.get(own, 0) + 1
                hits[own, verdict] = hits.get((own, verdict), 0) + 1
    total = len(labelled)
    good = {
        (own, v): n / count[own]
        for (own, v), n in hits.items()
        if n >= U.MIN_SUPPORT * total and n / count[own] >= U.MIN_CONFIDENCE
    }
    def beaten(own, v):
        parts = [tuple(t for t in own if t != x) for x in own]
        return any(good.get((p, v), -1) >= good[own, v] for p in parts)

    return {(own, v, round(c, 9)) for (own, v), c in good.items() if not beaten(own, v)}, good


def test_mined_rules_and_matches_equal_brute_force(spark):
    labelled = [
        (["first:en", "label:a", "suffix:x.com"], "block"), (["first:en", "label:b", "suffix:x.com"], "block"),
        (["first:de", "label:a", "suffix:x.com"], "allow"), (["first:de", "label:b", "suffix:y.com"], "allow"),
        (["first:en", "label:a", "suffix:y.com"], "allow"), (["first:en", "label:c", "suffix:y.com"], "allow"),
    ] * 3
    rules = U.mine_rules(spark.createDataFrame(labelled, "tokens array<string>, verdict string"))
    found = {(tuple(r["tokens"]), r["verdict"], round(r["confidence"], 9)) for r in rules.collect()}
    want, _ = slow_rules(labelled)
    assert found == want
    sets = [["first:en", "label:z", "suffix:x.com"], ["label:q"], ["first:de", "label:c"]]
    got = U.match_rules(spark.createDataFrame([(s,) for s in sets], "tokens array<string>"), rules)
    got = {tuple(r["tokens"]): r["mined"] for r in got.collect()}
    expected = {}
    for s in sets:
        fits = [(c, own, v) for own, v, c in found if set(own) <= set(s)]
        if fits:
            best = max(c for c, *_ in fits)
            expected[tuple(s)] = {v for c, _, v in fits if c == best}
    assert set(got) == set(expected) and all(got[s] in expected[s] for s in got)


def test_nothing_to_learn_from_gives_the_default(spark):
    rows = [(1, "http://a.org/x", *X), (2, None, *X)]
    found = U.judge_urls(spark.createDataFrame(rows, PAGES)).collect()
    assert {(r["page_id"], r["verdict"], r["method"]) for r in found} == {(1, "allow", "default"), (2, "allow", "default")}


def test_no_rows(spark):
    assert U.judge_urls(spark.createDataFrame([], PAGES)).collect() == []


def test_rules_of_any_length_equal_brute_force(spark):
    # Only all four tokens together are sure; every three of them also stand in the other verdict's URLs.
    from itertools import combinations

    four = ["label:a", "label:b", "path:c", "path:d"]
    labelled = [(four, "block")] * 40 + [(list(own), "allow") for own in combinations(four, 3)] * 2
    labelled += [(["label:e", "path:f"], "allow")] * 9
    rules = U.mine_rules(spark.createDataFrame(labelled, "tokens array<string>, verdict string"))
    found = {(tuple(r["tokens"]), r["verdict"], r["confidence"]) for r in rules.collect()}
    assert (tuple(four), "block", 1.0) in found
    want = set()
    total, least = len(labelled), U.MIN_SUPPORT * len(labelled)
    names = sorted({t for own, _ in labelled for t in own})
    good = {}
    for n in range(1, 7):
        for own in combinations(names, n):
            rows = [v for tokens, v in labelled if set(own) <= set(tokens)]
            for v in ("allow", "block"):
                k = rows.count(v)
                if k >= max(least, 1) and k / len(rows) >= U.MIN_CONFIDENCE:
                    good[own, v] = k / len(rows)
    for (own, v), c in good.items():
        if not any(good.get((tuple(t for t in own if t != x), v), -1) >= c for x in own):
            want.add((own, v, c))
    want.discard((("path:f",), "allow", 1.0))  # stands in the same URLs as label:e: one item
    assert found == want


def test_a_long_path_is_one_item(spark):
    import time

    def judge(segments):
        path = "/".join(f"s{j}" for j in range(segments))
        rows = [(k, f"http://h{k}.net/{'es' if k % 3 else 'fr'}/p{k}/{path}", *X) for k in range(10)]
        rows += [(10 + k, f"http://h{k}.com/{path}", *X) for k in range(10)]  # the same path, the other verdict
        rows += [(100 + k, f"http://h{k}.{('com', 'net')[k % 2]}/{('a', 'es')[k % 2]}/x{k}", *X) for k in range(980)]
        rows += [(5000, f"http://z.org/{path}", *X), (5001, "http://z.org/es/s3", *X)]
        started = time.monotonic()
        found = U.judge_urls(spark.createDataFrame(rows, PAGES)).collect()
        return {r["page_id"]: r for r in found}, time.monotonic() - started

    judge(3)
    short, few = judge(8)
    long, many = judge(60)
    assert many < 2 * few + 5
    for k in short:
        assert (short[k]["verdict"], short[k]["method"]) == (long[k]["verdict"], long[k]["method"])
    assert long[5001]["verdict"] == "block" and long[5001]["method"] == "mined"
