"""Main text of web pages: flat text blocks classified by a decision tree over them and their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of HTML elements and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the scan goes on behind their end tag.
RAW = frozenset("script style title noscript template iframe object svg audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td textarea tfoot th thead tr ul".split())
#: A new one of these ends an open one of its group, up to the nearest element that holds such groups.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"),
        "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
FRAME_TAGS = frozenset("aside button dialog footer form menu nav search select textarea".split())
FRAME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FRAME_NAMES = frozenset(
    "ad ads adbox adsense advert advertisement advertisements alert aside banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright discussion disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification outbrain pager pagination popup promo promotion promoted reactions recommended related replies reply "
    "respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola "
    "teaser teasers toolbar topbar widget widgets".split())
HEADER = frozenset({"header"})
NEUTRAL = frozenset({"with", "without", "has", "no", "is"})

_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
_TAG = re.compile(r"""<!--(?s:.*?)(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""")
#: The same for a page in which a quote is not closed.
_LOOSE = re.compile(r"""<!--(?s:.*?)(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*>""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


@dataclass
class Block:
    """One flat text block: its text, how many of its words are links, and where it stands."""

    text: str
    words: int
    linked: int
    frame: int
    article: int


def _names(value: str) -> Iterator[list[str]]:
    for name in value.split():
        yield [p.lower() for p in _NAME.findall(name)]


def _marks(tag: str, attrs: str) -> tuple[int, int]:
    """(frame, header): whether an element by its own tag, role, class or id frames the page, or heads it."""
    frame, header = int(tag in FRAME_TAGS), int(tag == "header")
    if not attrs.strip(" /\t\r\n\f"):
        return frame, header
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true":
            frame = 1
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            frame = 1
        elif key == "role" and value.strip().lower() in FRAME_ROLES:
            frame = 1
        elif key in ("class", "id") and tag not in ("html", "body", "main"):
            for parts in _names(value):
                if NEUTRAL.isdisjoint(parts) and parts:
                    frame |= int(parts[0] in FRAME_NAMES or parts[-1] in FRAME_NAMES)
                    header |= int(parts[0] in HEADER or parts[-1] in HEADER)
    return frame, header


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a page in page order: text between block-level tags, references decoded,
    white space as single spaces.  Scripts, styles, titles, comments and other content that is not
    text make no block.  Unclosed and stray tags are taken as browsers take them; once a tag's quote
    is not closed up to the end of the page, quotes no longer hide a ">".
    """
    page = page or ""
    out: list[Block] = []
    #: open elements: tag, frames at or above it, articles at or above it, links at or above it
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    pieces: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    at, end, last, tag_at = 0, len(page), page.rfind(">"), _TAG

    def flush() -> None:
        if pieces:
            text = "".join(p for p, _ in pieces)
            words = text.split()
            if words:
                linked = sum(len(p.split()) for p, link in pieces if link)
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), min(stack[-1][1], 1), min(stack[-1][2], 1)))
            pieces.clear()

    def say(raw: str) -> None:
        if raw:
            pieces.append((html.unescape(raw) if "&" in raw else raw, stack[-1][3]))

    def close(tags, stop=()) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                opened.subtract(e[0] for e in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    while at < end:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):  # no tag ends behind this
            say(page[at:])
            break
        m = tag_at.match(page, lt)
        if m is None and tag_at is _TAG and page[lt + 1:lt + 3].lstrip("/")[:1].isalpha():
            tag_at = _LOOSE
            m = tag_at.match(page, lt)
        if m is None:  # a "<" that begins no tag
            say(page[at:lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
                close((tag,))
            elif tag == "br":
                pieces.append((" ", 0))
            elif opened[tag]:
                if stack[-1][0] == tag and stack[-1][1] > stack[-2][1]:
                    flush()  # a framed part of a line is a block of its own
                close((tag,), BLOCK)
            continue
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            at = found.end() if found else end
            continue
        if tag in BLOCK:
            flush()
            close(("p",), BLOCK)
            if tag in ENDS:
                group, holders = ENDS[tag]
                close(group.split(), holders.split())
        if tag in VOID:
            if tag == "br":
                pieces.append((" ", 0))
            continue
        frame, header = _marks(tag, m[3])
        if tag == "a":
            close(("a",), BLOCK)
        elif not frame and tag not in BLOCK:  # other inline elements change nothing
            continue
        if frame and tag not in BLOCK:
            flush()
        _, frames, articles, links = stack[-1]
        framed = frame or (header and not articles)
        opened[tag] += 1
        stack.append((tag, frames + int(framed), articles + int(tag in ("article", "main")), links + int(tag == "a")))
    flush()
    return out


#: Pages whose blocks are held at a time.
SLICE = 64
#: Block features, in the order of the columns that the tree reads.
FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after",
            "in a frame", "in the article", "page has an article")


def features(page: list[Block]) -> np.ndarray:
    """One row per block: own and neighbours' word count and link density, place in the page.
    Beyond the first and last block stand empty ones."""
    if not page:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in page], float)
    density = np.array([b.linked for b in page], float) / np.maximum(words, 1)
    before, after = np.r_[0.0, words[:-1]], np.r_[words[1:], 0.0]
    d_before, d_after = np.r_[0.0, density[:-1]], np.r_[density[1:], 0.0]
    article = np.array([b.article for b in page], float)
    frame = np.array([b.frame for b in page], float)
    has = np.full(len(page), float((article * (1 - frame)).any()))
    return np.stack([words, density, before, d_before, after, d_after, frame, article, has], axis=1)


#: The labelled table: pages of blocks "place words linked label"; place is a (article), f (frame outside
#: an article), x (frame inside an article) or o (neither); label 1 is main text.
LABELLED = """
f 1 1 0, f 1 1 0, f 2 2 0, f 8 0 0, a 6 0 1, a 45 0 1, a 60 2 1, a 1 0 1, a 3 0 1, f 9 0 0
f 2 2 0, f 3 3 0, o 7 0 0, a 9 0 1, a 120 5 1, a 4 4 1, a 80 0 1, x 12 0 0, x 30 0 0, f 14 2 0
f 1 1 0, f 40 0 0, a 1 0 1, a 2 0 1, a 18 0 1, o 35 0 0, o 12 3 0, f 6 0 0
o 2 2 0, o 25 0 0, a 30 0 1, x 2 2 0, x 3 3 0, a 26 1 1, x 45 0 0, x 70 0 0, o 50 0 0
a 5 0 1, a 300 0 1, a 2 2 1, a 220 10 1, a 1 0 1, x 1 0 0, x 90 2 0
a 8 0 1, a 2 2 0, a 2 2 0, a 1 1 0, a 3 3 0, a 50 0 1, a 40 3 1
a 5 2 1, a 6 3 1, a 10 5 1, a 12 9 1, a 3 3 1, a 25 12 1, a 7 0 1, a 18 18 1, a 2 1 1
f 1 1 0, a 12 0 1, a 25 25 1, a 33 0 1, a 3 0 1, o 4 0 0, o 140 0 0
o 1 1 0, o 2 2 0, o 1 1 0, o 6 0 1, o 40 0 1, o 75 2 1, o 12 0 1, o 55 0 1, o 4 2 0, o 3 3 0
f 2 2 0, f 3 3 0, o 5 0 1, o 32 0 1, o 28 8 1, f 25 0 0, f 60 0 0, o 2 2 0
o 3 3 0, o 2 2 0, o 90 0 1, o 2 0 1, o 110 4 1, o 6 0 1, o 60 20 1, o 4 4 0, o 5 5 0
f 10 0 0, f 5 0 0, o 8 0 1, o 22 0 1, o 19 0 1, o 30 30 0, o 5 3 0, o 9 5 0
o 4 3 0, o 3 2 0, o 17 1 1, o 65 3 1, o 48 15 1, o 9 0 1, o 70 0 1, f 33 0 0, f 41 1 0
o 2 2 0, o 3 2 0, o 85 6 1, o 7 0 1, o 36 0 1, o 6 5 0, o 7 7 0, f 12 0 0
f 4 4 0, o 14 0 1, o 52 20 1, o 24 3 1, o 8 6 0, o 2 2 0, f 30 1 0
a 10 0 1, a 44 5 1, a 3 3 0, a 2 2 0, a 4 4 0, a 27 0 1, a 6 4 1, a 15 8 1, f 5 5 0
f 6 0 0, a 70 0 1, a 5 5 1, a 64 0 1, a 22 22 1, a 51 3 1, o 28 0 0, o 3 3 0
o 70 0 1
a 3 0 1
f 3 0 0, f 20 0 0
o 2 2 0, o 5 5 0, o 4 4 0
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of :data:`LABELLED`."""
    xs, ys = [], []
    for line in LABELLED.strip().splitlines():
        rows = [r.split() for r in line.split(",")]
        xs.append(features([Block("", int(w), int(n), int(p in "fx"), int(p in "ax")) for p, w, n, _ in rows]))
        ys += [int(y) for *_, y in rows]
    return np.concatenate(xs), np.array(ys)


@dataclass
class Tree:
    """Node of a decision tree: rows with ``x[feature] <= cut`` go left; a leaf has a label only."""

    label: int
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.label)
        out, go = np.empty(len(x), int), x[:, self.feature] <= self.cut
        out[go], out[~go] = self.left.predict(x[go]), self.right.predict(x[~go])
        return out


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Decision tree by Gini impurity; the first feature and the lowest cut win ties."""
    leaf = Tree(int(2 * y.sum() >= len(y)))
    if depth == 0 or len(set(y.tolist())) < 2:
        return leaf
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        n_left, left = at + 1.0, ones[at]
        n_right, right = len(y) - n_left, ones[-1] - left
        loss = left * (n_left - left) / n_left + right * (n_right - right) / n_right
        if len(at) and (best is None or loss.min() < best[0] - 1e-12):
            i = int(loss.argmin())
            best = (loss[i], f, (v[at[i]] + v[at[i] + 1]) / 2)
    if best is None:
        return leaf
    _, f, cut = best
    go = x[:, f] <= cut
    return Tree(leaf.label, f, float(cut), fit_tree(x[go], y[go], depth - 1), fit_tree(x[~go], y[~go], depth - 1))


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """Per page, its blocks that the tree takes for main text, joined by one space."""
    found = [blocks(p) for p in pages]
    keep = iter(tree.predict(np.concatenate([features(page) for page in found])).tolist())
    return [" ".join(b.text for b in page if next(keep)) for page in found]


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """``pages`` with the main text of each whole page in ``text_col``; every row and other column stays.

    Pages are read one by one in the task that has them: no shuffle, and nothing is kept of a page
    but its blocks.  The tree is fitted on the labelled table unless one is given.  Null or empty
    pages, and pages without main text, give an empty text; repeated rows give repeated rows; a
    column that already has the name of the text is replaced.
    """
    tree = tree or fit_tree(*labelled_table())
    pages = pages.withColumn(text_col, F.col(html_col)) if text_col == html_col else pages.drop(text_col).withColumn(text_col, F.col(html_col))
    names = pages.columns
    at = names.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in pages.schema.fields])

    def run(batches):
        for b in batches:
            column = b.column(at)
            texts = pa.array([x for i in range(0, b.num_rows, SLICE) for x in main_texts(column.slice(i, SLICE).to_pylist(), tree)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=names)

    return pages.mapInArrow(run, schema)
