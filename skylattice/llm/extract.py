"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Block elements are nodes; inline ones belong to the block around them. Features of a node are its
tag, the tokens of its class, id and role, its depth, its place among its siblings, and how dense
text, links and paragraphs are below it and in its parent. The trees say how likely the article
reaches into the node. Decoding keeps a rooted subtree: a node that is dropped drops all below it,
and the kept set has the greatest sum of log-odds, weighted by the text that nodes hold themselves.

The trees learn from a bounded sample of TRAIN_PAGES pages by hashed id: each as it is, if article
or main elements say where its article is, and rebuilt TEMPLATES times from its own paragraphs,
with menus, sidebars, notices, comments, forms and adverts around and inside an article of known
place. Every page is then scored whole.

Defined results: null, empty or text-less html gives the empty text; repeated rows are extracted
each; unclosed tags close where HTML closes them; a tag that never ends is text; a
script, style, title, textarea or select that never ends reaches to the end of the page.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

TRAIN_PAGES, TEMPLATES = 240, 3
TREES, DEPTH, SEED = 20, 4, 7
BATCH_NODES = 10_000

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*+)>""",
    re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
#: Elements that hold no text of the page, with what ends each; the source itself is searched, as lower() changes lengths.
RAW = {t: re.compile(rf"</{t}(?![a-zA-Z0-9])", re.I | re.A) for t in ("script", "style", "title", "textarea", "select", "head")}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption",
    "nav", "header", "footer", "aside", "form", "fieldset", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "dialog", "menu", "hgroup", "center", "legend", "label", "button",
}
ENDS_P = BLOCKS - {"label", "button", "body", "html"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "menu", "article", "section", "div", "main", "body", "html"}
SHELL = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "address"]
TEXTUAL = ["p", "h1", "h2", "h3", "li", "blockquote", "td", "pre", "figcaption", "dd"]
HOLDER = ["article", "main", "section", "div", "ul", "table", "body", "html"]
OUTSIDE = set("ad ads advert advertisement banner sponsor promo nav navbar menu navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget related share social comment comments commentlist respond reply notice cookie cookies consent alert popup modal form login signup subscribe newsletter search pagination pager copyright legal toolbar rating complementary contentinfo".split())
INSIDE = set("article content main post entry story body text articlebody prose".split())
FEATURES = len(SHELL) + len(TEXTUAL) + len(HOLDER) + 18


class Page:
    """Block elements in order of their start, and their own runs of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["html"], [-1], [frozenset()]
        self.blocks: list[tuple[int, str]] = []
        self.links: dict[int, int] = {}
        self.stack, self.inline = [0], []
        self.run: list[str] = []
        at = 0
        while (m := TAG.search(source, at)) is not None:
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing = name.lower(), m[1] or m[4]
            if closing:
                self.close(name)
            elif name in RAW:
                if name != "head" and not (m[3] or m[6] or "").endswith("/"):
                    end = RAW[name].search(source, at)
                    at = source.find(">", end.start()) + 1 or len(source) if end else len(source)
            elif name == "br" or name == "hr":
                self.run.append(" ")
            elif name in BLOCKS:
                self.open(name, m[3] or m[6] or "")
            elif name == "a":
                self.inline.append("a")
        if at < len(source):
            self.text(source[at:])
        self.flush()

    def text(self, piece: str) -> None:
        piece = html.unescape(piece) if "&" in piece else piece
        self.run.append(piece)
        if self.inline:
            self.links[self.stack[-1]] = self.links.get(self.stack[-1], 0) + len(piece)

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.blocks.append((self.stack[-1], text))
            self.run = []

    def open(self, name: str, attributes: str) -> None:
        self.flush()
        self.inline = []
        if name in ("html", "body") and name in (self.tag[k] for k in self.stack[:3]):
            return
        if name in ENDS_P:
            self.pop({"p"}, SCOPE)
        if name in SAME:
            self.pop(SAME[name], SCOPE)
        found = frozenset(t for g in NAMES.findall(attributes) for v in g if v for t in TOKEN.findall(v.lower())) if attributes else frozenset()
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.names.append(found)
        self.stack.append(len(self.tag) - 1)

    def pop(self, names: set[str], scope: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            here = self.tag[self.stack[k]]
            if here in names:
                del self.stack[k:]
                return
            if here in scope:
                return

    def close(self, name: str) -> None:
        if name == "a":
            self.inline = []
        if name not in BLOCKS:
            return
        self.flush()
        self.inline = []
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == name:
                del self.stack[k:]
                return


def below(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over subtrees; parents come before their children."""
    total = values.astype(float).copy()
    for i in range(len(parent) - 1, 0, -1):
        total[parent[i]] += total[i]
    return total


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """One row of FEATURES numbers for each node, and the characters that it holds itself."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, links = np.zeros(n), np.zeros(n)
    for node, text in page.blocks:
        own[node] += len(text)
    for node, size in page.links.items():
        links[node] += size
    tag = np.array(page.tag)
    paragraph = tag == "p"
    text, link, tags, paragraphs = (below(parent, v) for v in (own, links, np.ones(n), paragraph))
    stops = below(parent, np.zeros(n))
    for node, t in page.blocks:
        stops[node] += t.count(".") + t.count(",")
    stops = below(parent, stops)
    depth, index, count = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        index[i] = count[parent[i]]
        count[parent[i]] += 1
    up = np.maximum(parent, 0)
    out = np.array([len(x & OUTSIDE) for x in page.names], float)
    inside = np.array([len(x & INSIDE) for x in page.names], float)
    shell = np.isin(tag, SHELL).astype(float)
    holds = np.isin(tag, ["article", "main"]) | (inside > 0)
    reach_out, reach_in = (out > 0) | (shell > 0), holds.copy()
    for i in range(1, n):
        reach_out[i] |= reach_out[parent[i]]
        reach_in[i] |= reach_in[parent[i]]
    has_in = below(parent, holds) > 0
    columns = [tag == t for t in (*SHELL, *TEXTUAL, *HOLDER)]
    columns += [np.log1p(own), np.log1p(text), text / tags, link / np.maximum(text, 1), paragraphs / tags, np.log1p(stops), stops / np.maximum(text, 1), depth, index, count[up], index / np.maximum(count[up], 1)]
    columns += [text / np.maximum(text[up], 1), link[up] / np.maximum(text[up], 1), out, inside, reach_out, reach_in, has_in]
    return np.stack([np.asarray(c, float) for c in columns], axis=1), own


def decode(parent: np.ndarray, odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The rooted subtree of greatest weighted log-odds, as one flag for each node."""
    weight = odds * (0.25 + np.log1p(own))
    keep, drop = weight.copy(), -weight
    for i in range(len(parent) - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    kept = np.zeros(len(parent), bool)
    kept[0] = True
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and keep[i] > drop[i]
    return kept


class Trees:
    """Boosted trees as arrays; odds() are the log-odds of rows of features."""

    def __init__(self, model):
        self.trees = []
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            nodes: list[list[float]] = []

            def add(node, nodes=nodes) -> int:
                k = len(nodes)
                nodes.append([0, 0.0, k, k, node.prediction()])
                if node.numDescendants():
                    nodes[k][:2] = node.split().featureIndex(), node.split().threshold()
                    nodes[k][2] = add(node.leftChild())
                    nodes[k][3] = add(node.rightChild())
                return k

            add(tree._call_java("rootNode"))
            feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
            self.trees.append((feature.astype(int), threshold, left.astype(int), right.astype(int), 2 * weight * value))

    def odds(self, rows: np.ndarray) -> np.ndarray:
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(rows), int)
            for _ in range(DEPTH):
                at = np.where(rows[each, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return total


class Lexicon:
    """Stands in for the trees where the sample gives nothing to learn from: names and tags alone."""

    def odds(self, rows: np.ndarray) -> np.ndarray:
        return np.where(rows[:, -3] > 0, -1.0, 1.0)


def marked(page: Page) -> np.ndarray | None:
    """Which nodes the article reaches into, as article and main elements say; None without them."""
    tag, parent = page.tag, page.parent
    state = [0] * len(tag)
    for i in range(len(tag)):
        outer = state[parent[i]] if i else 0
        out = tag[i] in SHELL or page.names[i] & OUTSIDE
        state[i] = 2 if outer == 2 or (out and tag[i] not in ("article", "main")) else 1 if outer == 1 or tag[i] in ("article", "main") else 0
    held = {k for k, _ in page.blocks}
    return labels_of(page, [s == 1 and i in held for i, s in enumerate(state)]) if any(s == 1 and i in held for i, s in enumerate(state)) else None


def labels_of(page: Page, content: list[bool]) -> np.ndarray:
    """A node is positive if content lies in it or below it."""
    return below(np.array(page.parent), np.array(content)) > 0


def rebuilt(texts: list[str], rng: random.Random) -> str:
    """A page of known article, made of the given paragraphs; content elements are marked with data-x."""
    e = html.escape

    def some(n: int) -> list[str]:
        return [e(rng.choice(texts)) for _ in range(n)]

    def short() -> str:
        words = rng.choice(texts).split()
        k = rng.randrange(max(1, len(words)))
        return e(" ".join(words[k : k + rng.randint(1, 5)]))

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{x}</p>" for x in some(n))

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(rng.randint(3, 9))) + "</ul>"

    def outside() -> str:
        return rng.choice([
            lambda: f'<aside class="sidebar"><h3>{short()}</h3>{menu()}{paragraphs(rng.randint(0, 2))}</aside>',
            lambda: f'<div id="sidebar"><h3>{short()}</h3>{paragraphs(rng.randint(1, 3))}</div>',
            lambda: f'<section class="comments"><h2>{short()}</h2>' + "".join(f'<div class="comment"><p>{x}</p></div>' for x in some(rng.randint(1, 5))) + "</section>",
            lambda: f'<div id="comments"><ol class="commentlist">' + "".join(f"<li>{x}</li>" for x in some(rng.randint(1, 4))) + "</ol></div>",
            lambda: f'<form class="search"><label>{short()}</label><input><button>{short()}</button></form>',
            lambda: f'<form action="/x"><p>{rng.choice(some(1))}</p><button>{short()}</button></form>',
            lambda: f'<div class="{rng.choice(["notice", "cookie-banner", "alert", "popup"])}">{rng.choice(some(1))}</div>',
            lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsor", "promo"])}">{rng.choice([short(), *some(1)])}</div>',
            lambda: f'<div class="related">{menu()}</div>',
            lambda: f'<div class="share">{short()} <a href="#">{short()}</a></div>',
            lambda: f'<nav class="breadcrumb"><a href="/">{short()}</a> <a href="/a">{short()}</a></nav>',
        ])()

    body = [f"<{t} data-x>{e(rng.choice(texts))}</{t}>" for t in rng.choices(["p", "p", "p", "p", "h2", "li", "blockquote", "div"], k=rng.randint(1, 9))]
    body = [f"<ul>{x}</ul>" if x.startswith("<li") else x for x in body]
    for _ in range(rng.choice([0, 0, 1, 2])):
        body.insert(rng.randrange(len(body) + 1), outside())
    heading = rng.choice(["", f"<h1 data-x>{short()}</h1>", f"<h1 data-x>{short()}</h1>"])
    open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post-body">', "</div></div>"), ('<div class="entry">', "</div>"), ("<div>", "</div>"), ("", ""), ('<main><article class="post">', "</article></main>")])
    top = rng.choice([f"<header><h2>{short()}</h2><nav>{menu()}</nav></header>", f"<nav>{menu()}</nav>", f'<div class="header">{short()}</div><div class="menu">{menu()}</div>', f'<div id="nav">{menu()}</div>', ""])
    foot = rng.choice([f"<footer>{short()}</footer>", f'<div class="footer">{short()}<p>{short()}</p></div>', f"<footer>{menu()}{paragraphs(1)}</footer>", ""])
    around = [outside() for _ in range(rng.randint(0, 4))]
    cut = rng.randrange(len(around) + 1)
    return f"<html><body>{top}{''.join(around[:cut])}{open_}{heading}{''.join(body)}{close}{''.join(around[cut:])}{foot}</body></html>"


class MarkedPage(Page):
    """A rebuilt page, whose content elements carry data-x."""

    def __init__(self, source: str):
        self.content: list[bool] = [False]
        super().__init__(source)

    def open(self, name: str, attributes: str) -> None:
        n = len(self.tag)
        super().open(name, attributes)
        self.content += ["data-x" in attributes] * (len(self.tag) - n)


def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html) to the features and labels of the nodes of pages as they are and rebuilt."""
    for batch in batches:
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            rows, labels = [], []
            truth = marked(page)
            if truth is not None:
                rows.append(features(page)[0])
                labels.append(truth)
            texts = [t for _, t in page.blocks if len(t) > 40] or [t for _, t in page.blocks]
            rng = random.Random(f"{SEED} {len(source or '')} {texts[:1]}")
            for _ in range(TEMPLATES if texts else 0):
                made = MarkedPage(rebuilt(texts, rng))
                rows.append(features(made)[0])
                labels.append(labels_of(made, made.content))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(np.concatenate(rows)), pa.list_(pa.float64())), pa.array(np.concatenate(labels).astype(float))], ["features", "label"])


def fit_trees(pages: DataFrame) -> Trees | Lexicon:
    """Boosted trees fitted on TRAIN_PAGES pages at most."""
    n = pages.count()
    chosen = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // (2 * TRAIN_PAGES)))) == 0)
    chosen = chosen.orderBy(F.xxhash64("page_id", F.lit(1)), "page_id", F.xxhash64("html")).limit(TRAIN_PAGES)
    nodes = chosen.select("html").mapInArrow(examples, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label").coalesce(2).persist()
    try:
        if nodes.select("label").distinct().count() < 2:
            return Lexicon()
        return Trees(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=64).fit(nodes))
    finally:
        nodes.unpersist()


def extracting(trees: Trees | Lexicon):
    def texts(pages: list[Page]) -> Iterator[str]:
        parts = [features(p) for p in pages]
        odds = trees.odds(np.concatenate([rows for rows, _ in parts]))
        at = 0
        for page, (rows, own) in zip(pages, parts, strict=True):
            kept = decode(np.array(page.parent), odds[at : at + len(rows)], own)
            at += len(rows)
            yield "\n\n".join(text for node, text in page.blocks if kept[node])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "html"):
                out: list[str] = []
                waiting: list[Page] = []
                for source in part.column("html").to_pylist():
                    waiting.append(Page(source or ""))
                    if sum(len(p.tag) for p in waiting) >= BATCH_NODES:
                        out += texts(waiting)
                        waiting = []
                out += texts(waiting) if waiting else []
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page (page_id, url, html)."""
    rows = tk.only(pages, "page_id", "url", "html")
    return rows.mapInArrow(extracting(fit_trees(rows)), "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(tk.table(spark, sf_dir, "pages"))
