import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from atoflow.llm import queries, sketch

from .helpers import ROWS, awkward, empty, words

ALL = (1 << 63) - 1


def plain_hashes(text):
    w, n = words(text), sketch.SHINGLE
    shingles = [w[i:i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w] if w else []
    out = set()
    for s in shingles:
        h = 42
        for word in s:  # each word is hashed with the hash so far as seed
            h = xxhash.xxh64_intdigest(word.encode(), h)
        out.add(h & ALL)
    return sorted(out)


def plain_sketch(text):
    h, t = plain_hashes(text), sketch.threshold()
    below = [x for x in h if x < t]
    if len(below) >= sketch.FLOOR:
        return t - 1, below
    few = h[:sketch.FLOOR]
    return (ALL if len(h) <= sketch.FLOOR else few[-1]), few


def plain_containment(a, b):
    if not a[1] or not b[1]:
        return float(not a[1] and not b[1])
    bound = min(a[0], b[0])
    mine = [x for x in a[1] if x <= bound]
    return len(set(mine) & set(b[1])) / len(mine) if mine else 0.0


def plain_print(s):
    return f"{s[0]:016x}:" + ",".join(f"{x:016x}" for x in s[1])


def test_query_equals_the_plain_version(spark):
    d = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.document_fingerprints(spark, d).collect()}
    assert len(got) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + nxt[:cut]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(nxt)
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(a), plain_print(b))
        assert r.near_edited == pytest.approx(plain_containment(a, b)) and r.near_next == pytest.approx(plain_containment(a, c))


def test_estimates_are_near_the_truth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 3000")
    own = sketch.document_fingerprints(docs).withColumn("half", F.expr("substring(text, 1, length(text) div 2)"))
    got = own.select("text", "half", sketch.containment(F.col("sk"), sketch.sketch(F.col("half"))).alias("c")).collect()
    errors = []
    for r in got:
        a, b = set(plain_hashes(r.text)), set(plain_hashes(r.half))
        errors.append(r.c - len(a & b) / len(a))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.35


def test_merged_sketches_are_those_of_the_union(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 4000").select("text").limit(20)
    pairs = docs.crossJoin(docs.withColumnRenamed("text", "other").limit(3)).select(
        "text", "other", sketch.merge(sketch.sketch(F.col("text")), sketch.sketch(F.col("other"))).alias("m"))
    for r in pairs.collect():
        t = sketch.threshold()
        both = sorted(x for x in set(plain_hashes(r.text)) | set(plain_hashes(r.other)) if x < t)
        assert r.m.bound == t - 1 and r.m.kept == both


@pytest.mark.parametrize("size", [1, 2, 7])
def test_next_row_in_id_order(spark, size, monkeypatch):
    monkeypatch.setattr(sketch, "ROWS_PER_BUCKET", size)
    ids = [-2 ** 62, -5, -4, 0, 1, 2, 3, 70_000, 70_001, 2 ** 62, 2 ** 62 + 1]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids[::-1]], "id long, text string")
    got = {r.id: r.next.text for r in sketch.with_next(df, "id", ["text"]).collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_awkward_rows(spark):
    own = sketch.document_fingerprints(awkward(spark))
    got = sketch.with_next(own, "id", ["text", "sk"]).collect()
    assert len(got) == len(ROWS)
    # every row is the next of one row
    assert sorted(r.next.text for r in got) == sorted(t or "" for _, t in ROWS)
    prints = {}
    for r in own.select("text", sketch.fingerprint(F.col("sk")).alias("f")).collect():
        assert prints.setdefault(r.text, r.f) == r.f == plain_print(plain_sketch(r.text))


def test_empty_table(spark):
    assert sketch.with_next(sketch.document_fingerprints(empty(spark)), "id", ["text", "sk"]).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = queries.document_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_estimate_is_told_from_not_contained(spark, scratch):
    """Short texts before a long one that holds them whole: 0.0 without a comparable hash is no estimate."""
    parts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(60)]
    whole = " ".join(parts)
    spark.createDataFrame([(2 * i + k, (t, whole)[k]) for i, t in enumerate(parts) for k in (0, 1)],
                          "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    got = {r.doc_id: r for r in queries.document_fingerprints(spark, scratch).collect()}
    undefined = 0
    for i, t in enumerate(parts):
        a, c = plain_sketch(t), plain_sketch(whole)
        n = sum(h <= min(a[0], c[0]) for h in a[1])
        assert got[2 * i].near_next_hashes == n and got[2 * i].near_next == float(n > 0)
        undefined += n == 0
    assert 0 < undefined < len(parts)
