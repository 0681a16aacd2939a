"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags, each with
its ancestors' tags and the words of their classes and ids.  The field has two labels,
text and furniture; a block's features are its ancestors and simple measures of its text,
and neighbouring labels depend on each other.  Viterbi gives the best labels of a page.

The field is trained on labelled pages.  Pages that mark their text (``article`` or
``main``) tell which blocks are text; from a bounded sample of them the trainer lays
the same blocks out anew in other kinds of page, in which the labels are known by construction: other
containers, table layouts, comments under the text, notices, forms, adverts between
paragraphs.  So the field learns what furniture looks like rather than one tag's name.
Training runs on the driver; pages are then labelled in a narrow step without a shuffle.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import importable

SAMPLE_PAGES = 240  # the bound of the training sample
SAMPLE_CHARS = 60_000  # longer pages are not sampled, others are read whole
EPOCHS = 6
RATE = 0.2
RIDGE = 1e-4
SEED = 3

# How HTML elements are laid out.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr br img object canvas audio video "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mstyle mspace mpadded mphantom menclose mtable mtr mtd semantics".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNSEEN = frozenset(
    "script style noscript template head title svg iframe annotation annotation-xml".split()
)
# Start tags that leave an open head open; the end tag may be missing.
IN_HEAD = frozenset(
    "html head base basefont bgsound link meta noframes noscript script style template title".split()
)
# A start tag that ends an open element of the same group.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("table ul ol dl body html article section div main".split())
NAME = re.compile(r"[a-z]+")


class Place:
    """An open element with its ancestors, kept once for all blocks in it.

    ``found`` are the features that the element adds to its ancestors': tags, without inline
    ones, and words of classes and ids, each where it comes up first.  ``tags`` and ``names``
    number the whole sequences, so that equal ones of a page have equal numbers.
    """

    __slots__ = ("parent", "tag", "pair", "found", "tags", "names")

    def __init__(self, parent: Place | None, tag: str, pair: str, found: tuple[str, ...], tags: int, names: int):
        # Parents that add nothing are passed over.
        while parent is not None and not parent.found:
            parent = parent.parent
        self.parent, self.tag, self.pair, self.found = parent, tag, pair, found
        self.tags, self.names = tags, names

    def features(self) -> list[str]:
        """Features of a block's ancestors."""
        parts, at = [], self
        while at is not None:
            parts.append(at.found)
            at = at.parent
        return [f for found in reversed(parts) for f in found] + [f"own:{self.tag}", f"pair:{self.pair}"]


@dataclass
class Block:
    text: str
    place: Place
    linked: int = 0  # characters inside links
    label: int = 0


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, Place]] = []
        self.seen: set[str] = set()  # features of the open elements
        self.numbers: dict[tuple[int, str], int] = {}
        self.open: Counter[str] = Counter()
        self.head_at = 0
        self.holders: list[int] = []  # places in the stack of elements that may hold any tag
        self.parts: list[str] = []
        self.linked = 0
        self.unseen = 0
        self.heads = 0
        self.anchors = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            place = self.stack[-1][1] if self.stack else Place(None, "", "", (), 0, 0)
            self.blocks.append(Block(text, place, self.linked))
        self.parts, self.linked = [], 0

    def _place(self, tag: str, words: list[str]) -> Place:
        parent = self.stack[-1][1] if self.stack else None
        if parent and not words and tag in INLINE:
            return parent
        near, pair, tags, names = (parent.tag, parent.pair, parent.tags, parent.names) if parent else ("", "", 0, 0)
        found = []
        if tag not in INLINE:
            near, pair = tag, f"{near}>{tag}" if near else tag
            tags = self.numbers.setdefault((tags, tag), len(self.numbers) + 1)
            found.append(f"in:{tag}")
        for word in words:
            if f"named:{word}" not in self.seen:
                names = self.numbers.setdefault((names, f"named:{word}"), len(self.numbers) + 1)
                found.append(f"named:{word}")
        found = tuple(f for f in found if f not in self.seen) if found else ()
        self.seen.update(found)
        return Place(parent, near, pair, found, tags, names)

    def _drop(self, at: int) -> None:
        below = self.stack[at - 1][1] if at else None
        for tag, place in self.stack[at:]:
            if place is not below:
                self.seen.difference_update(place.found)
            below = place
            self.open[tag] -= 1
            self.unseen -= tag in UNSEEN
            self.heads -= tag == "head"
            self.anchors -= tag == "a"
        del self.stack[at:]
        while self.holders and self.holders[-1] >= at:
            self.holders.pop()

    def _leave_head(self, everything: bool) -> None:
        """Close the head; not while an element in it that may hold any tag is open, if not asked to."""
        if everything or not (self.holders and self.holders[-1] > self.head_at):
            self._drop(self.head_at)

    def handle_starttag(self, tag, attrs):
        if self.heads and tag not in IN_HEAD:
            self._leave_head(tag == "body")
        if tag not in INLINE:
            self.flush()
            groups = CLOSES.get(tag, ())
            closes = any(self.open[t] for t in ("p", *groups))
            for at in range(len(self.stack) - 1 if closes else -1, -1, -1):
                open_ = self.stack[at][0]
                if open_ == "p" or open_ in groups:
                    self._drop(at)
                    if open_ != "p":
                        break
                elif open_ in SCOPES or (groups and open_ not in INLINE):
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        words = []
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                words += NAME.findall(value.lower())
        self.stack.append((tag, self._place(tag, list(dict.fromkeys(words)))))
        if tag == "head" and not self.heads:
            self.head_at = len(self.stack) - 1
        if tag in ("noscript", "template"):
            self.holders.append(len(self.stack) - 1)
        self.open[tag] += 1
        self.unseen += tag in UNSEEN
        self.heads += tag == "head"
        self.anchors += tag == "a"

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for at in range(len(self.stack) - 1 if self.open[tag] else -1, -1, -1):
            if self.stack[at][0] == tag:
                self._drop(at)
                return
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return

    def handle_data(self, data):
        if self.heads and self.stack[-1][0] == "head" and data.strip():
            self._leave_head(True)
        if not self.unseen:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)


def blocks_of(html: str | None) -> list[Block]:
    """The visible leaf blocks of a page in page order; broken markup is read as it stands."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def text_features(block: Block, k: int, n: int, before: Block | None) -> list[str]:
    """Features of a block's text and its place among the blocks."""
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    found = [
        f"words:{min(words, 64).bit_length()}",
        f"linked:{int(share * 3.99)}",
        f"end:{text[-1] if text[-1] in '.!?:,;' else ''}",
        f"stops:{min(3, text.count('. ') + text.count(', '))}",
        "first" if k == 0 else "last" if k == n - 1 else "inner",
    ]
    lower = text.lower()
    if "©" in text or "copyright" in lower or "all rights reserved" in lower:
        found.append("rights")
    if "cookie" in lower or "subscribe" in lower or "newsletter" in lower or "sign up" in lower:
        found.append("notice")
    if "advert" in lower or "sponsored" in lower:
        found.append("advert")
    if before is not None and (before.place.tags, before.place.names) == (
        block.place.tags,
        block.place.names,
    ):
        found.append("like before")
    return found


@dataclass
class Field:
    """Weights of the features (towards text) and of label pairs."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self):
        self.by_name = dict(zip(self.index, self.weights.tolist()))

    def __getstate__(self):
        return self.index, self.weights, self.bias, self.pairs

    def __setstate__(self, state):
        self.index, self.weights, self.bias, self.pairs = state
        self.__post_init__()

    def scores(self, blocks: list[Block]) -> list[float]:
        get, out = self.by_name.get, []
        above: dict[Place, float] = {}  # sums of what places and their ancestors add
        for k, b in enumerate(blocks):
            new, at = [], b.place
            while at is not None and at not in above:
                new.append(at)
                at = at.parent
            known = above[at] if at is not None else 0.0
            for place in reversed(new):
                for f in place.found:
                    known += get(f, 0.0)
                above[place] = known
            known += get(f"own:{b.place.tag}", 0.0) + get(f"pair:{b.place.pair}", 0.0)
            features = text_features(b, k, len(blocks), blocks[k - 1] if k else None)
            out.append(self.bias + known + sum(get(f, 0.0) for f in features))
        return out

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The most probable labels; ties go to furniture."""
        pairs = self.pairs.tolist()
        best, back = None, []
        for s in self.scores(blocks):
            if best is None:
                best = (0.0, s)
                continue
            row, new = [], []
            for label, own in ((0, 0.0), (1, s)):
                stay, move = best[0] + pairs[0][label], best[1] + pairs[1][label]
                row.append(0 if stay >= move else 1)
                new.append(max(stay, move) + own)
            back.append(row)
            best = tuple(new)
        if best is None:
            return []
        labels = [0 if best[0] >= best[1] else 1]
        for row in reversed(back):
            labels.append(row[labels[-1]])
        return labels[::-1]


def train_field(pages: list[list[Block]], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood by AdaGrad over pages, with forward and backward sums."""
    counts = Counter()
    rows = []
    for blocks in pages:
        own = []
        for k, b in enumerate(blocks):
            found = b.place.features()
            found += text_features(b, k, len(blocks), blocks[k - 1] if k else None)
            own.append(found)
            counts.update(set(found))
        rows.append(own)
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= 2))}
    n = len(index)
    w = np.zeros(n + 1)  # the last one is the bias
    pairs = np.zeros((2, 2))
    gw, gp = np.full(n + 1, 1e-2), np.full((2, 2), 1e-2)
    data = []
    for blocks, own in zip(pages, rows):
        at = [[index[f] for f in found if f in index] + [n] for found in own]
        if at:
            data.append((at, np.array([b.label for b in blocks])))
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for p in rng.permutation(len(data)):
            at, labels = data[p]
            m = len(at)
            own = np.zeros((m, 2))
            own[:, 1] = [w[a].sum() for a in at]
            ahead, behind = np.zeros((m, 2)), np.zeros((m, 2))
            ahead[0] = own[0]
            for k in range(1, m):
                x = ahead[k - 1][:, None] + pairs
                ahead[k] = np.logaddexp(x[0], x[1]) + own[k]
            for k in range(m - 2, -1, -1):
                x = pairs + (behind[k + 1] + own[k + 1])[None, :]
                behind[k] = np.logaddexp(x[:, 0], x[:, 1])
            total = np.logaddexp(*ahead[-1])
            p1 = np.exp(ahead[:, 1] + behind[:, 1] - total)
            g = p1 - labels
            flat = np.concatenate(at)
            grad = np.bincount(flat, np.repeat(g, [len(a) for a in at]), n + 1)
            used = np.unique(flat)
            step = grad[used] + RIDGE * w[used]
            gw[used] += step**2
            w[used] -= RATE * step / np.sqrt(gw[used])
            if m > 1:
                joint = np.exp(
                    ahead[:-1, :, None] + pairs + (own[1:] + behind[1:])[:, None, :] - total
                ).sum(axis=0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (labels[:-1], labels[1:]), 1)
                gp += (joint - seen) ** 2
                pairs = pairs - RATE * (joint - seen) / np.sqrt(gp)
    return Field(index, w[:-1], float(w[-1]), pairs)


def marked_labels(blocks: list[Block]) -> list[Block]:
    """Labels by the page's own marks: text stands in ``article`` or ``main``."""
    for b in blocks:
        places = set(b.place.features())
        inside = "in:article" in places or "in:main" in places
        apart = places & {"in:nav", "in:aside", "in:footer", "in:header", "in:form"}
        b.label = int(inside and not apart)
    return blocks


# Names that pages give to their parts, by role.
TEXT_NAMES = (
    "content", "post", "article", "entry content", "main", "story", "article body", "body",
    "post content", "text", "page content", "entry", "main content", "blog post", "story body", "",
)
FURNITURE_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav links main-menu tabs",
    "header": "header masthead top site-header banner branding topbar logo tagline",
    "footer": "footer site-footer bottom copyright legal foot colophon credits",
    "side": "sidebar side aside related widget widgets rail right-column popular recent trending "
    "recommended more-stories tags categories archive read-more",
    "notice": "notice cookie cookie-banner alert popup modal consent gdpr newsletter subscribe "
    "paywall message promo-bar toast disclaimer",
    "advert": "ad ads advert advertisement sponsored promo banner-ad adsense sponsor ad-slot "
    "commercial partner",
    "form": "form search login signup contact subscribe-form searchbox register",
    "comments": "comments comment discussion responses comment-list replies reply disqus reactions "
    "user-comments thread feedback",
    "share": "share social sharing author meta byline share-buttons toolbar pagination pager",
}
SHORT_LINES = (
    "Home", "About", "Contact us", "Privacy policy", "Terms of use", "Log in", "Sign up", "Search",
    "Read more", "Next", "Previous", "Share this", "Reply", "Menu", "Subscribe", "More", "Archive",
    "We use cookies to improve this site.", "Subscribe to our newsletter.", "Advertisement",
    "Sponsored content", "All rights reserved.", "Accept", "Follow us", "Related articles",
    "Leave a comment", "Comments", "Your email address", "Popular posts", "Tags", "Help",
)


class Layouts:
    """Pages with known labels, laid out from real blocks of text and of furniture."""

    def __init__(self, texts: list[str], lines: list[str], seed: int = SEED):
        self.texts, self.lines = texts or ["text."], [*lines, *SHORT_LINES]
        self.random = random.Random(seed)
        self.labels: list[int] = []

    def _attr(self, name: str) -> str:
        if not name:
            return ""
        joined = self.random.choice((" ", "-", "_")).join(name.split())
        return f' {self.random.choice(("class", "class", "id"))}="{joined}"'

    def _leaf(self, tag: str, text: str, label: int, inner: str = "{}") -> str:
        self.labels.append(label)
        return f"<{tag}>{inner.format(escape(text))}</{tag}>"

    def _line(self) -> str:
        r = self.random
        pool = self.lines if r.random() < 0.7 else self.texts
        text = r.choice(pool)
        return text if r.random() < 0.5 else " ".join(text.split()[: r.randint(1, 12)])

    def furniture(self, role: str) -> str:
        r = self.random
        name = r.choice(FURNITURE_NAMES[role].split())
        tags = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"),
                "side": ("aside", "div", "section"), "form": ("form", "form", "div"),
                "comments": ("section", "div", "div", "ol")}
        tag = r.choice(tags.get(role, ("div", "div", "section", "p")))
        own_name = "" if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5 else name
        body = ""
        for _ in range(r.randint(1, 6) if role != "notice" else r.randint(1, 2)):
            linked = "<a href='/x'>{}</a>"
            if role in ("menu", "share") or (role in ("footer", "side") and r.random() < 0.6):
                body += self._leaf("li" if tag == "ul" else r.choice(("li", "li", "p")), self._line(), 0, linked)
            elif role == "comments":
                text = r.choice(self.texts) if r.random() < 0.7 else self._line()
                body += f"<div{self._attr('comment')}>" + self._leaf("p", text, 0) + "</div>"
            elif role == "form":
                body += self._leaf(r.choice(("button", "div", "p", "legend")), self._line(), 0)
            else:
                titles = ("h1", "h2", "p", "div") if role == "header" else ("p", "div", "p", "h3")
                body += self._leaf(r.choice(titles), self._line(), 0)
        if tag == "p":  # a single leaf
            del self.labels[-body.count("</") :]
            return self._named_leaf(name)
        return f"<{tag}{self._attr(own_name)}>{body}</{tag}>"

    def _named_leaf(self, name: str) -> str:
        self.labels.append(0)
        return f"<p{self._attr(name)}>{escape(self._line())}</p>"

    def text(self, inside: list[str]) -> str:
        r = self.random
        out = ""
        if r.random() < 0.8:
            out += self._leaf(r.choice(("h1", "h1", "h2")), " ".join(r.choice(self.texts).split()[:10]), 1)
        for _ in range(r.randint(1, 9)):
            if inside and r.random() < 0.25:
                out += self.furniture(r.choice(inside))
            x = r.random()
            text = r.choice(self.texts)
            if x < 0.08:
                out += self._leaf("h2", " ".join(text.split()[:6]), 1)
            elif x < 0.16:
                for _ in range(r.randint(2, 4)):
                    kind = "ul"
                    out += f"<{kind}>" + self._leaf("li", " ".join(text.split()[:15]), 1) + f"</{kind}>"
            elif x < 0.22:
                out += "<blockquote>" + self._leaf("p", text, 1) + "</blockquote>"
            else:
                short = text if r.random() < 0.8 else " ".join(text.split()[: r.randint(1, 8)])
                inner = r.choice(("{}", "{}", "<b>{}", "{} <a href='/y'>x</a>", "<span>{}</span>"))
                out += self._leaf("p" if r.random() < 0.85 else "div", short, 1, inner)
        return out

    def page(self) -> list[Block]:
        """One page's blocks with their labels."""
        r = self.random
        self.labels = []
        out = "<html><head><title>x</title></head><body>"
        for role in ("header", "menu", "notice", "advert", "form"):
            if r.random() < (0.6 if role in ("header", "menu") else 0.3):
                out += self.furniture(role)
        wrap = r.choice(("", "", "<div class='wrapper'>", "<div id='page'>", "<table><tr><td>"))
        out += wrap
        if r.random() < 0.3:
            out += self.furniture("side")
        tag = r.choice(("article", "article", "main", "div", "div", "section", "td", ""))
        name = r.choice(TEXT_NAMES) if tag in ("div", "section", "td") else ""
        inside = r.sample(("advert", "share", "notice", "side", "form"), 3) if r.random() < 0.6 else []
        inner = self.text(inside)
        if r.random() < 0.35:
            inner += self.furniture("comments")
        out += f"<{tag}{self._attr(name)}>{inner}</{tag}>" if tag else inner
        for role in ("share", "side", "comments", "advert"):
            if r.random() < 0.3:
                out += self.furniture(role)
        out += {"<table><tr><td>": "</td></tr></table>", "": ""}.get(wrap, "</div>")
        for role in ("form", "notice", "footer"):
            if r.random() < (0.75 if role == "footer" else 0.2):
                out += self.furniture(role)
        blocks = blocks_of(out + "</body></html>")
        if len(blocks) != len(self.labels):  # empty leaves make no block
            return []
        for b, label in zip(blocks, self.labels):
            b.label = label
        return blocks


def train_on(htmls: list[str], layouts_per_page: int = 4) -> Field:
    """A field from sampled pages: those that mark their text, and layouts of their blocks."""
    pages, texts, lines = [], [], []
    for html in htmls:
        blocks = marked_labels(blocks_of(html))
        if any(b.label for b in blocks):
            pages.append(blocks)
            texts += [b.text for b in blocks if b.label]
            lines += [b.text for b in blocks if not b.label]
    layouts = Layouts(texts[:5000], lines[:5000])
    made = [layouts.page() for _ in range(max(1000, layouts_per_page * len(pages)))]
    return train_field(pages + [m for m in made if m])


def main_text(html: str | None, model: Field) -> str:
    """The page's text blocks, joined by line breaks."""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, label in zip(blocks, model.viterbi(blocks)) if label)


def fit(pages: DataFrame, html_column: str = "html") -> Field:
    """Train on at most ``SAMPLE_PAGES`` whole pages of at most ``SAMPLE_CHARS``, taken by the hash of their html.

    Null pages are not sampled, repeated ones once; no rows give a field trained on made layouts only.
    """
    html = F.col(html_column).cast("string")
    share = min(1.0, 4 * SAMPLE_PAGES / max(1, pages.count()))
    low = F.shiftrightunsigned(F.xxhash64(html), 1) <= F.lit(min(int(share * 2.0**63), (1 << 63) - 1))
    marked = F.lower(html).contains("<article") | F.lower(html).contains("<main")
    short = F.length(html) <= SAMPLE_CHARS
    sample = pages.where(low & marked & short).select(html.alias("h"))
    sample = sample.groupBy(F.xxhash64("h").alias("k")).agg(F.min("h").alias("h"))
    rows = sample.orderBy("k").limit(SAMPLE_PAGES).collect()
    return train_on([r["h"] for r in rows])


def extracted(html: Column, model: Field, spark) -> Column:
    """The main text of whole pages; null and empty pages give an empty text.

    A narrow step: repeated rows get equal texts, no rows give none, other columns are not read.
    """
    importable(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def of_pages(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for part in column:
            yield pd.Series([main_text(h, own) for h in part], dtype="object")

    return of_pages(html.cast("string"))
