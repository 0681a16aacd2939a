from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanecast.llm import html as H

from . import edge


def page(k):
    body = "".join(f"<p>{edge.prose(12 + 7 * j, k + j)}.</p>" for j in range(4))
    return (
        f"<html><head><title>t</title><script>x('</p>')</script></head><body><nav><ul><li><a href=/>Home</a>"
        f"</li></ul></nav><div class=ad>Buy {k}</div><article><h1>{edge.prose(5, k)}</h1>{body}</article>"
        f"<footer>&copy; {k}</footer></body></html>"
    )


@pytest.fixture(scope="module")
def model():
    return H.train_on([page(k) for k in range(60)])


def test_blocks():
    read = lambda s: [b.text for b in H.blocks_of(s)]
    assert read("<p>a &amp; b&nbsp;&#99;\n\t d<br>e<p><b>f</b>g<p>") == ["a & b c d e", "fg"]
    assert read("x<script>var a='<p>no</p>'</script><style>p{}</style><!-- no -->y") == ["x", "y"]
    assert read(None) == read("") == read("<div> </div>") == []
    assert read("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert read("</p></div>a</b>") == ["a"]
    assert read("<div>" * 3000 + "deep") == ["deep"]
    assert read("a < b <") == ["a < b <"]


def test_a_head_without_its_end_tag():
    read = lambda s: [b.text for b in H.blocks_of(s)]
    assert read("<html><head><title>t</title><body><p>a</p><div>b</div></body></html>") == ["a", "b"]
    assert read("<head><meta name=x><title>t</title><link rel=y><p>a<p>b") == ["a", "b"]
    assert read("<head><title>t</title><style>p{}</style><a href=/>a</a> b") == ["a b"]
    assert read("<head><title>t</title>\n plain <b>text</b>") == ["plain text"]
    assert read("<head><title>t<body>a") in (["a"], [])  # newer parsers read a title up to its end tag
    assert read("<head><head><title>t</title></head><body>a") == ["a"]
    # What stands in a head, or in an element there that may hold any tag, leaves it open.
    assert read("<head><script>x</script><template><p>t</p></template><title>t</title></head>a") == ["a"]
    assert read("<head><noscript><img src=x><p>n</p></noscript><title>t</title></head><body>a") == ["a"]


def test_formulas_and_fallback_text_are_kept():
    read = lambda s: [b.text for b in H.blocks_of(s)]
    assert read("<p>Let <math><mi>x</mi><mo>=</mo> 5</math> hold.</p>") == ["Let x= 5 hold."]
    assert read("<p>See <object data=x>a chart</object> and <canvas>b</canvas>.</p>") == ["See a chart and b."]
    assert read("<p>a</p><video src=x><p>b</p><p>c</p>") == ["a", "b", "c"]  # no end tag
    assert read("<p>x<math><semantics><mi>y</mi><annotation>\\y</annotation></semantics></math></p>") == ["xy"]


def test_places_are_the_same_as_whole_paths():
    html = (
        "<div class='a b'>1<p id=b>2<b class='c a'>3</b></p><div role=c>4<ul><li class=a>5<li>6</ul></div></div>"
        "<div class='a b'><p id=b>7</p></div><p>8</p><i class=d>9</i>"
    )
    blocks = H.blocks_of(html)
    want = {  # text: features of the ancestors; inline elements add names only
        "1": "in:div named:a named:b own:div pair:div",
        "23": "in:div named:a named:b in:p own:p pair:div>p",
        "4": "in:div named:a named:b named:c own:div pair:div>div",
        "5": "in:div named:a named:b named:c in:ul in:li own:li pair:ul>li",
        "6": "in:div named:a named:b named:c in:ul in:li own:li pair:ul>li",
        "7": "in:div named:a named:b in:p own:p pair:div>p",
        "8": "in:p own:p pair:p",
    }
    for b in blocks[:-1]:
        assert sorted(b.place.features()) == sorted(want[b.text].split()), b.text
    alike = {(b.place.tags, b.place.names) for b in blocks if b.text in ("23", "7")}
    assert len(alike) == 1


def test_deep_pages_take_linear_time(model):
    import time

    for tag in ("<div>x", "<blockquote class=q>x", "</q><b>x", "<head><noscript><div>x", "<li><ul>x"):
        started = time.monotonic()
        text = H.main_text(tag * 100_000, model)
        assert time.monotonic() - started < 60, tag
        assert set(text) <= {"x", "\n"}


def test_pages_without_the_heads_end_tag_give_their_text(model):
    for k in range(60, 80):
        assert H.main_text(page(k).replace("</head>", ""), model) == H.main_text(page(k), model) != ""


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(0)
    model = H.Field({}, np.zeros(0), 0.0, rng.standard_normal((2, 2)))
    for n in range(1, 8):
        scores = rng.standard_normal(n).tolist()
        model.scores = lambda blocks, s=scores: s

        def value(labels, s=scores):
            pairs = sum(model.pairs[a][b] for a, b in zip(labels, labels[1:]))
            return pairs + sum(x for x, l in zip(s, labels) if l)

        best = max(product((0, 1), repeat=n), key=value)
        assert tuple(model.viterbi([None] * n)) == best


def test_marked_pages(model):
    for k in range(60, 80):
        want = [edge.prose(5, k)] + [edge.prose(12 + 7 * j, k + j) + "." for j in range(4)]
        assert H.main_text(page(k), model) == "\n".join(want)


def test_held_out_layouts(model):
    made = H.Layouts([edge.prose(20, k) + "." for k in range(50)], ["Go", "Shop now"], seed=77)
    right = total = 0
    for _ in range(200):
        blocks = made.page()
        labels = model.viterbi(blocks)
        right += sum(b.label == l for b, l in zip(blocks, labels))
        total += len(blocks)
    assert right / total > 0.95


PAGES = "page_id long, url string, html string, text string, h string, k string"


def test_edge_rows(spark, model):
    long = "<article>" + "".join(f"<p>{edge.prose(40, k)}.</p>" for k in range(2000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", page(3)), (None, "u", page(3)), (4, "u", long), (5, "u", "<p>")]
    rows = [r + ("t", "h", "k") for r in rows]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    found = pages.select("page_id", "html", H.extracted(F.col("html"), model, spark).alias("got")).collect()
    assert len(found) == 6
    for r in found:
        assert r["got"] == H.main_text(r["html"], model)
        if not r["html"]:
            assert r["got"] == ""
    (got,) = [r["got"] for r in found if r["page_id"] == 4]
    assert got.count("\n") == 1999


def test_sample_and_no_rows(spark):
    rows = [(k, "u", page(k), "t", "h", "k") for k in range(20)] + [(99, "u", None, "t", "h", "k")]
    model = H.fit(spark.createDataFrame(rows, PAGES))
    assert edge.prose(5, 1) in H.main_text(page(1), model)
    empty = spark.createDataFrame([], PAGES)
    model = H.fit(empty)
    assert empty.select(H.extracted(F.col("html"), model, spark)).collect() == []
    assert isinstance(H.main_text(page(1), model), str)
