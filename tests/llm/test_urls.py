import re

import pytest
from pyspark.sql import functions as F

from atoflow.llm import queries, urls

URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/1#a",
    "http://x.com/de/1", "http://x.com/de", "http://com/de/", "http://org", "http://org?x", "no scheme", "", None, "://", "://h/p", "a://b://c/d",
    "ftp://user@h.org:80/es/", "http://www.bad.net/index.html", "http://bad.net/", "http://bad.net", "http://bad.net/x/", "http://bad.net/x", "http://www.BAD.net/x?y",
    "http://a..org/fr/", "http://ünï.com/fr/é", "http://x.com/fr/" + "long/" * 20_000, "http://h\n.com/de/\nx",
]


def plain(url, rules, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]+", lambda x: x[0].lower(), host)
    fits = [(len(k), k, v) for k, v in rules for h, p in [k.split("/", 1)] if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    canon = re.sub(r"^www\.", "", host) + re.sub(r"(/index\.html?)?/?\Z", "", path) if host else None
    hit = canon in listed
    _, rule, verdict = max(fits, default=(0, None, "block" if hit else "allow"))
    return host, path, rule, verdict, hit


def test_verdicts_equal_the_plain_version(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS[:3]])], "page_id long, url string, key string, listed string")
    rules = spark.createDataFrame(queries.RULES, "key string, verdict string")
    listed = {"bad.net", "bad.net/x", "org", "nowhere.net/y"}
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, rules, spark.createDataFrame([(x,) for x in listed], "key string")).collect()}
    assert got == {i: plain(u, queries.RULES, listed) for i, u in enumerate([*URLS, *URLS[:3]])}


def test_no_rules_no_list_no_pages(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules, listed = spark.createDataFrame([], "key string, verdict string"), spark.createDataFrame([], "key string")
    assert {r.verdict for r in urls.judge(pages, rules, listed).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), spark.createDataFrame(queries.RULES, "key string, verdict string"), listed).count() == 0


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_filter_loses_no_key_and_the_join_is_exact(spark, most, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BLOCKS", most)
    listed = spark.range(0, 5000, 2).select(F.concat(F.lit("h/"), "id").alias("key"))
    probes = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("key"))
    words, blocks = urls.bloom_filter(listed)
    hits = {r.key for r in urls.possible(probes, "key", words, blocks).collect()}
    assert {f"h/{i}" for i in range(0, 5000, 2)} <= hits
    if most > 1:
        assert len(hits) < 2500 * 1.02
    assert {r.key for r in urls.listed_keys(probes, listed).collect()} == {f"h/{i}" for i in range(0, 5000, 2)}
