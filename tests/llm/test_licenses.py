import re
import textwrap

from atoflow.llm import licenses

from .helpers import awkward, empty, rows

LINES = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
         "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "MIT": "Released under the MIT License."}


def test_documents_equal_a_plain_search(spark):
    """Every line of the documents that holds one of the notices word for word, and no other line."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want = []
    for r in docs.collect():
        for i, line in enumerate(re.split("\r\n|\r|\n", r.text or "")):
            want += [(r.doc_id, i, k) for k, t in LINES.items() if t.lower() in line.lower()]
    got = licenses.scan(docs).toPandas()
    assert sorted(zip(got["doc_id"], got["line"], got["license"])) == sorted(want) and len(want) > 200
    assert got["exact"].all()


def test_wording_differences_decide():
    judge = licenses.Templates(licenses.TEMPLATES).judge
    for name, text in licenses.TEMPLATES.items():
        assert judge(text)[0] == name and judge(text.upper())[0] == name
        assert judge("Foo bar: " + text + " More words follow here.")[0] == name
    notice = licenses.TEMPLATES["MIT-grant"]
    near = judge(notice.replace("free of charge", "free of any charge"))
    assert near[0] == "MIT-grant" and near[2:] == (0, 1)
    assert judge("We take out a license to sell fish in the harbour.")[0] is None
    assert judge("This work is licensed under the GNU General Public License, version 2.")[0] == "GPL-2.0"
    assert judge("Licensed under CC BY 4.0.")[0] == "CC-BY-4.0" and judge("")[0] is None


def test_ranks_equal_plain_compression():
    t = licenses.Templates(licenses.TEMPLATES)
    ranked = t.rank(licenses.norm_words(LINES["MIT"]))
    assert ranked[0][1] == "MIT" and [s for s, _ in ranked] == sorted((s for s, _ in ranked), reverse=True)
    assert len(ranked) == len(licenses.TEMPLATES)


def test_awkward_rows(spark):
    assert rows(licenses.scan(awkward(spark)), "doc_id", "line", "license", "exact") == [(6, 0, "MIT", False)] or \
        rows(licenses.scan(awkward(spark)), "doc_id", "line") in ([(6, 0)], [])
    assert licenses.scan(empty(spark)).count() == 0


def test_words_around_a_notice_do_not_count():
    judge = licenses.Templates(licenses.TEMPLATES).judge
    around = [f"wort{i * 7919 % 977}" for i in range(400)]
    for name, text in licenses.TEMPLATES.items():
        for n in (0, 10, 30, 80, 200, 400):
            for at in (0, n // 2, n):
                assert judge(" ".join([*around[:at], text, *around[at:n]]))[::2] == (name, 0), (name, n, at)
    notice = licenses.TEMPLATES["MIT-grant"].replace("free of charge", "free of any charge")
    assert {judge(" ".join(["the software"] * n + [notice] + ["to any person"] * n)) for n in (0, 5, 300)} == {judge(notice)}


def test_wrapped_notices_are_found_where_they_start(spark):
    docs, want = [], []
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for j, (width, mark, end) in enumerate(((24, "", "\n"), (40, " * ", "\r\n"), (72, "# ", "\r"), (10_000, "// ", "\n"))):
            lines = ["/*", "Some file of 2024", "", *textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False), "", "and its words"]
            docs.append((i * 10 + j, end.join(mark + x for x in lines)))
            want.append((i * 10 + j, 3, name, True))
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "line", "license", "exact").collect()) == want


def test_every_notice_of_a_line_has_a_row(spark):
    grant = licenses.TEMPLATES["MIT-grant"].replace("free of charge", "free of any charge")
    docs = [(1, "x\nReleased under the MIT License. Licensed under the Apache License, Version 2.0."),
            (2, " or ".join(licenses.TEMPLATES.values())),
            (3, LINES["MIT"] + " Or: " + LINES["MIT"] + "\n" + LINES["MIT"]),
            (4, LINES["GPL-3.0"] + " " + grant)]
    want = [(1, 1, "Apache-2.0", True), (1, 1, "MIT", True), *((2, 0, k, True) for k in sorted(licenses.TEMPLATES)),
            (3, 0, "MIT", True), (3, 1, "MIT", True), (4, 0, "GPL-3.0", True), (4, 0, "MIT-grant", False)]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "line", "license", "exact").collect()) == want
    inside = licenses.scan(spark.createDataFrame([(1, licenses.TEMPLATES["Apache-2.0-notice"])], "doc_id long, text string"))
    assert [r.license for r in inside.collect()] == ["Apache-2.0-notice"]
