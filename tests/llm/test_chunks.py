import hashlib

import pytest
from pyspark.sql import functions as F

from atoflow.llm import chunks

from .helpers import ROWS, awkward, empty, rows


def norm(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def plain(data):
    out = []
    for i, t in data:
        same = [(-len(u or ""), j is not None, j if j is not None else 0, j) for j, u in data if norm(u) == norm(t)]
        out.append((i, min(same)[3], len(same), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [2, 64])
def test_awkward_rows(spark, bits):
    """Two bits make the first salt collide, so the proof has to take another."""
    got = chunks.exact_dedup(awkward(spark), bits=bits)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == plain(ROWS)
    assert got.filter("kept").groupBy("text_sha256").count().filter("count > 1").count() == 0
    assert got.filter("kept").count() == len({norm(t) for _, t in ROWS})
    assert got.filter("kept and not doc_id <=> keep_id").count() == 0


def test_collisions_are_found(spark):
    assert chunks.collisions(awkward(spark), "text", 1, 2).count() > 0
    assert chunks.collisions(awkward(spark), "text", 1, 64).count() == 0


def test_chunks_join_to_the_text_and_follow_the_content(spark):
    body = "".join(f"Sentence number {i * i} ends with {i * 7919 % 1009:x}. " for i in range(3000))
    texts = [body, "An insertion at the start! " + body, "x" * 20_000, "", "漢字。" * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.c for r in df.select("i", chunks.chunk_list(chunks.normalised(F.col("text"))).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert "".join(got[i]) == norm(t) and all(1 <= len(c) <= 4096 for c in got[i])
    assert len(set(got[0]) & set(got[1])) > 0.9 * len(got[0])


def test_kept_rows(spark):
    df = awkward(spark)
    kept = chunks.drop_exact_copies(df)
    assert kept.schema == df.schema
    got = rows(kept, "doc_id", "text")
    assert len(got) == len({norm(t) for _, t in ROWS}) and len({norm(t) for _, t in got}) == len(got)
    assert (1, ROWS[1][1]) in got and (0, ROWS[0][1]) not in got  # the longer text stays


def test_empty_table(spark):
    assert chunks.exact_dedup(empty(spark)).count() == 0
    assert chunks.drop_exact_copies(empty(spark)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = chunks.exact_dedup(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
