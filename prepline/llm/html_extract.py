"""Operator 7, HTML extraction: a tree-structured graphical model over the DOM.

The block elements of a page and the runs of text in them form a tree; each node is content
or not. A node's own evidence is a log odds from its tag, words in its class, id and role,
and its share of link text, its length and punctuation; parent and child are tied by a table
of potentials. Sum-product messages go up the tree and down again, which gives each node's
content marginal exactly; the text runs with a marginal of at least one half are the main text.

Training: pages that mark their main text themselves (an ``article`` or ``main`` element)
are the labelled ones; of those a hash sample of at most ``SAMPLE_PAGES`` pages, and of their
nodes at most ``SAMPLE_NODES``, fits the weights by ridge regression towards ``DEFAULT``, and
the potentials by counts on top of ``TIES``. Evidence that no labelled page shows keeps its
default weight, so pages without such elements are judged by the same model.

Text: character references are decoded, scripts, styles and comments of the markup never
become text, inline elements do not break a block, white space within a block becomes one
space, blocks are joined by one space in page order. Nothing is cut: whole pages, any depth.

Defined results: a null or empty html has an empty text; broken markup is read as far as it
goes, unclosed elements end with their parents; a head is no element here, only what is in it is
silent, so it needs no end; a silent element without its own end tag is silent up to its first
block only, and what follows counts as if it had ended there; repeated rows are extracted each; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 400
SAMPLE_NODES = 40_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title svg iframe object canvas select textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: an opening tag ends the open element of these names, unless one of SCOPE is in between
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul figure".split())
SCOPE = frozenset("article aside body div footer form header html main nav section table ul ol dl blockquote".split())

POOR = re.compile(r"nav|menu|header|footer|sidebar|aside|advert|banner|promo|sponsor|cookie|notice|consent|popup|modal|newsletter|subscribe|signup|share|social|related|recommend|comment|disqus|repl(?:y|ies)|breadcrumb|paginat|widget|login|search|copyright|legal|toolbar|masthead|skip", re.I)
POOR_WORDS = frozenset("ad ads adv side meta tags toc alert".split())
GOOD = re.compile(r"article|content|main|post|entry|story|body", re.I)

FEATURES = ["bias", "article", "main", "p", "heading", "list", "div", "nav", "header", "footer", "aside", "form", "poor", "good", "links", "words", "stops", "text"]
DEFAULT = np.array([-0.5, 8.0, 8.0, 0.5, 0.5, 0.0, 0.0, -7.0, -7.0, -7.0, -7.0, -7.0, -7.0, 4.0, -3.0, 0.1, 0.3, 0.0])
#: prior counts of (parent, child) states, not content first
TIES = np.array([[30.0, 6.0], [2.0, 30.0]])
LEAST_TIES = np.array([[0.0, 0.02], [0.05, 0.0]])
#: pull of the weights towards DEFAULT, per node
RIDGE = 0.5


class Page(HTMLParser):
    """The tree of a page: per node its parent, tag, attributes' words and, for runs of text, the
    text. Parents come before their children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words, self.text = [-1], ["html"], [""], [""]
        self.link_chars = [0]
        self.open: list[int] = [0]
        #: open silent elements: tag and the state before them, which their end tag brings back
        self.silent: list[tuple] = []
        self.label = False  # whether the run is the first of a silent element
        self.links = 0
        self.run: list[str] = []
        self.run_links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text and not self.label:
            self.add("#text", "", text, min(len(text), self.run_links))
        self.run, self.run_links, self.label = [], 0, False

    def hush(self, tag: str) -> None:
        """A silent element starts: it is read like others until its end tag takes that back."""
        self.silent.append((tag, len(self.tag), self.open[:], self.run, self.run_links, self.links, self.label))
        self.flush()
        self.label = True

    def unhush(self, tag: str) -> None:
        for k in range(len(self.silent) - 1, -1, -1):
            if self.silent[k][0] == tag:
                _, n, self.open, self.run, self.run_links, self.links, self.label = self.silent[k]
                for a in (self.parent, self.tag, self.words, self.text, self.link_chars):
                    del a[n:]
                del self.silent[k:]
                return

    def left(self) -> None:
        """Silent elements whose parent has ended are over, although their end tag did not come."""
        while self.silent and len(self.silent[-1][2]) > len(self.open):
            self.silent.pop()

    def add(self, tag: str, words: str, text: str = "", links: int = 0) -> int:
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.link_chars.append(links)
        return len(self.tag) - 1

    def end(self, names: Iterable[str], scope: frozenset[str] = frozenset(), floor: int = 1) -> None:
        for k in range(len(self.open) - 1, floor - 1, -1):
            t = self.tag[self.open[k]]
            if t in names:
                del self.open[k:]
                return
            if t in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.hush(tag)
            return
        if tag == "body" and self.silent and self.silent[-1][0] == "title":
            self.flush()
            self.silent.pop()
        if tag == "a":
            self.links += 1
        if tag == "br":
            self.run.append(" ")
        if tag in INLINE or tag in VOID and tag != "hr":
            return
        self.flush()
        self.links = 0  # links do not reach over a block's border
        # what a tag ends by itself lies in the same silent element
        floor = len(self.silent[-1][2]) if self.silent else 1
        if tag in ENDS:
            self.end(ENDS[tag], SCOPE - ENDS[tag], floor)
        elif tag in CLOSES_P:
            self.end({"p"}, SCOPE, floor)
        if tag in VOID or tag in ("html", "head", "body"):
            return
        self.open.append(self.add(tag, " ".join(v for k, v in attrs if k in ("class", "id", "role", "aria-label") and v)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.unhush(tag)
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE or tag in VOID or tag in ("html", "head", "body"):
            return
        self.flush()
        self.end({tag}, frozenset() if tag in SCOPE else SCOPE)
        self.left()

    def handle_data(self, data: str) -> None:
        self.run.append(data)
        if self.links:
            self.run_links += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


def read(html: object) -> Page:
    page = Page()
    if isinstance(html, str) and html:
        page.feed(html)
        page.close()
    page.flush()
    return page


def evidence(page: Page) -> np.ndarray:
    n = len(page.tag)
    chars, links, words, stops = (np.zeros(n) for _ in range(4))
    for i in range(n - 1, 0, -1):
        t = page.text[i]
        if t:
            chars[i], links[i], words[i], stops[i] = len(t), page.link_chars[i], t.count(" ") + 1, t.count(".") + t.count(",") + t.count("!") + t.count("?")
        p = page.parent[i]
        for a in (chars, links, words, stops):
            a[p] += a[i]
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = 1
    for i, (tag, attr) in enumerate(zip(page.tag, page.words, strict=True)):
        if tag == "#text":
            x[i, 17] = 1
            continue
        kind = "heading" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else "list" if tag in ("ul", "ol", "li", "dl", "dt", "dd") else "form" if tag == "fieldset" else tag
        if kind in FEATURES[1:12]:
            x[i, FEATURES.index(kind)] = 1
        if attr:
            x[i, 12] = bool(POOR.search(attr) or POOR_WORDS & set(re.split(r"[^a-z]+", attr.lower())))
            x[i, 13] = bool(GOOD.search(attr))
    x[:, 14] = links / np.maximum(chars, 1)
    x[:, 15] = np.log1p(words)
    x[:, 16] = np.minimum(1.0, 10 * stops / np.maximum(words, 1))
    return x


def marginals(parent: list[int], odds: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Content marginals by sum-product: tie[s][c] the potential of a parent's state s and a child's
    state c. Upward messages in reverse order, downward in order, each normalised."""
    n = len(parent)
    own = [1 / (1 + math.exp(min(30.0, max(-30.0, o)))) for o in odds]  # weight of state 0; 1 - that of state 1
    up0, up1 = own[:], [1 - v for v in own]
    m0, m1 = [1.0] * n, [1.0] * n
    (t00, t01), (t10, t11) = tie.tolist()
    for i in range(n - 1, 0, -1):
        a, b = up0[i], up1[i]
        u, v = t00 * a + t01 * b, t10 * a + t11 * b
        s = u + v
        m0[i], m1[i] = u / s, v / s
        p = parent[i]
        a, b = up0[p] * m0[i], up1[p] * m1[i]
        s = a + b
        up0[p], up1[p] = a / s, b / s
    full0, full1 = up0[:], up1[:]
    for i in range(1, n):
        p = parent[i]
        a, b = full0[p] / m0[i], full1[p] / m1[i]
        d0, d1 = a * t00 + b * t10, a * t01 + b * t11
        a, b = up0[i] * d0, up1[i] * d1
        s = a + b
        full0[i], full1[i] = a / s, b / s
    return np.array(full1)


def marked(page: Page) -> np.ndarray | None:
    """Of a page that marks its main text: the share of each node's text that lies in it."""
    inside = np.zeros(len(page.tag))
    for i in range(1, len(page.tag)):
        inside[i] = page.tag[i] in ("article", "main") or inside[page.parent[i]]
    if not inside.any():
        return None
    total, good = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for i in range(len(page.tag) - 1, 0, -1):
        total[i] += len(page.text[i])
        good[i] += len(page.text[i]) * inside[i]
        total[page.parent[i]] += total[i]
        good[page.parent[i]] += good[i]
    return good / np.maximum(total, 1)


class Model:
    def __init__(self, weights: np.ndarray = DEFAULT, ties: np.ndarray = TIES) -> None:
        self.weights = weights
        # bounded pulls, so that a node's own evidence can part it from its parent
        tie = np.maximum(ties / ties.sum(axis=1, keepdims=True), LEAST_TIES)
        self.tie = tie / tie.sum(axis=1, keepdims=True)

    def text_of(self, html: object) -> str:
        page = read(html)
        if len(page.tag) == 1:
            return ""
        content = marginals(page.parent, evidence(page) @ self.weights, self.tie)
        return " ".join(t for t, c in zip(page.text, content, strict=True) if t and c >= 0.5)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_nodes: int = SAMPLE_NODES) -> Model:
    """pages (page_id, html) -> the model fitted on the bounded sample of labelled pages."""
    known = pages.where(F.lower(F.col("html")).rlike("<(article|main)[ >]"))
    some = known.orderBy(F.xxhash64("page_id"), "page_id").select("html").limit(sample_pages)

    def nodes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for html in b["html"]:
                page = read(html)
                share = marked(page)
                if share is not None:
                    x = evidence(page)
                    y = share > 0.5
                    up = np.array(page.parent)
                    yield pd.DataFrame({"x": list(x), "y": y.astype(float), "above": np.where(up >= 0, y[up], -1).astype(float)})

    got = some.mapInPandas(nodes, "x array<double>, y double, above double").limit(sample_nodes).toPandas()
    if not len(got) or got["y"].nunique() < 2:
        return Model()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    w, ridge = DEFAULT.copy(), RIDGE * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - DEFAULT))
        w += change * min(1.0, 2.0 / max(1e-9, np.abs(change).max()))
        if np.abs(change).max() < 1e-6:
            break
    ties = TIES.copy()
    below = got["above"] >= 0
    np.add.at(ties, (got["above"][below].astype(int), got["y"][below].astype(int)), 1.0)
    return Model(w, ties)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    weights, tie = model.weights, model.tie

    def texts(batches: Iterable[pd.Series]) -> Iterator[pd.Series]:
        m = Model(weights, tie)
        for b in batches:
            yield pd.Series([m.text_of(h) for h in b], dtype=object)

    udf = F.pandas_udf(texts_with_hints(texts), "string")
    out = pages.select("page_id", "url", udf(F.col("html").cast("string")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def texts_with_hints(f):
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return f


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages))
