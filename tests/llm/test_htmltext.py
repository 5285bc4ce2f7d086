import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from atoflow.llm import htmltext, queries
from tests.llm.helpers import rows

TREE = htmltext.fit_tree(*htmltext.labelled_table())
LINE = "A line of the story that says something worth the reader's while."


def test_tree_learns_the_table():
    x, y = htmltext.labelled_table()
    assert len(y) < 200 and (TREE.predict(x) == y).all()


def test_tree_holds_for_pages_left_out():
    lines = htmltext.LABELLED.strip().splitlines()
    right = n = 0
    for i in range(len(lines)):
        parts = []
        for j, line in enumerate(lines):
            cells = [c.split() for c in line.split(",")]
            x = htmltext.features([htmltext.Block("", int(w), int(k), int(p in "fx"), int(p in "ax")) for p, w, k, _ in cells])
            parts.append((j == i, x, np.array([int(c[3]) for c in cells])))
        tree = htmltext.fit_tree(np.concatenate([x for held, x, _ in parts if not held]), np.concatenate([y for held, _, y in parts if not held]))
        x, y = next((x, y) for held, x, y in parts if held)
        right, n = right + int((tree.predict(x) == y).sum()), n + len(y)
    assert right / n >= 0.9


def test_features_are_the_block_and_its_neighbours():
    page = "<p>one two three</p><p><a href=x>four</a> five</p><p>six</p>"
    assert htmltext.features(htmltext.blocks(page))[:, :6].tolist() == [
        [3, 0, 0, 0, 2, .5], [2, .5, 3, 0, 1, 0], [1, 0, 2, .5, 0, 0]]


CASES = [
    (f"<div class='cookie-notice'>We use cookies.</div><main><header><h1>Title</h1></header><p>{LINE}<p>Short.</main><footer>f</footer>",
     f"Title {LINE} Short."),
    (f"<nav><a href=/>Home</a></nav><article><p>{LINE}</p><div class='ad'>Buy now and save much</div><p>End.</p>"
     f"<section id=comments><article class=comment><p>{LINE}</p></article></section></article>", f"{LINE} End."),
    (f"<header><h1>Site</h1><p>{LINE}</p></header><article><p>a &lt;b&gt; &amp;amp; &copy;</p><aside>{LINE}</aside></article>",
     "a <b> &amp; ©"),
    (f"<article><p>x<b>y</b>z<br>w \t\n v<form><label>{LINE}</label><input></form><p>after</article><div class=sidebar>{LINE}</div>",
     "xyz w v after"),
    ("<article><p>in <span class='ad'>buy this</span> line</p><p style='display:none'>hidden text</p></article>", "in line"),
    ("<article><script>if (a < b) x = '</p><p>no</p>'</script><p>yes<!-- <p>no</p> --></p><style>p{}</style></article>", "yes"),
    (f"<body class='has-sidebar'><ul class=menu><li><a>A</a><li><a>B</a></ul><div id=content><h2>Head of it</h2><p>{LINE} {LINE}</p></div>",
     f"Head of it {LINE} {LINE}"),
    ("<article><p class=\"a>b\">one</p><p title='x>y'>two</p></article>", "one two"),
    ("<article><p>one <a href=\"x>two</p><p>three</p></article>", "one two three"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("plain words only", "plain words only"),
    (None, ""), ("", ""), (" \n ", ""), ("<p></p>", ""), ("<!-- open", ""), ("<article><p>x<script>", "x"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert htmltext.main_texts([page, page], TREE) == [want, want]


def test_given_pages_give_their_articles(spark):
    """A second way: the article element cut out by a pattern, as the given pages mark it plainly."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op11_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_awkward_rows(spark):
    long = "<article>" + f"<p>{LINE}</p>" * 20_000 + "</article>"
    broken = "<p class=\"a'>" * 20_000 + "<" * 20_000 + '<a "' * 20_000 + "<div>" * 20_000
    df = spark.createDataFrame([(1, None, "k"), (None, "", None), (2, long, "k"), (2, long, "k"), (3, broken, "k")],
                               "page_id long, html string, text string").withColumn("words", F.lit(7))
    out = htmltext.extract(df)
    assert out.columns == ["page_id", "html", "words", "text"]
    got = out.select("page_id", "words", F.length("text").alias("n")).collect()
    n = (len(LINE) + 1) * 20_000 - 1
    assert sorted((r.page_id or 0, r.n) for r in got if r.page_id != 3) == [(0, 0), (1, 0), (2, n), (2, n)]
    assert htmltext.extract(df.limit(0)).count() == 0
    assert rows(htmltext.extract(df.filter("page_id = 1"), text_col="html"), "page_id", "html") == [(1, "")]
