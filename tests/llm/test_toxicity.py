import zlib

import numpy as np

from atoflow.llm import toxicity

from .helpers import ROWS, awkward, empty, labels


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_fold(spark):
    got = awkward(spark).select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()
    assert all(r.h == held(r.doc_id) for r in got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs.drop("score"), toxicity.train(docs, known)).select("doc_id", "score").toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    got = got.merge(known.toPandas(), on="doc_id")
    got = got[[held(i) for i in got["doc_id"]]]
    y, p = got["toxic"] == 1, got["score"] >= toxicity.CUT
    rank = got["score"].rank()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    f1 = 2 * (y & p).sum() / (y.sum() + p.sum())
    assert auc > 0.95 and f1 > 0.85, (auc, f1)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    d = "/root/testdata/sf0.001"
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = known.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.train(docs, known), toxicity.train(docs, flipped)
    assert a == b


def test_risk_is_kept_non_negative():
    """Few positives that a flexible model can memorise: the plain unbiased risk would run far below zero."""
    rng = np.random.default_rng(0)
    sparse = lambda m: toxicity.Rows(np.nonzero(m)[1], (m > 0).sum(1))

    def fitted(rows, features, known):
        x = (rng.random((rows, features)) < 0.1).astype(np.float32)
        y = rng.random(rows) < 0.3
        x[:, 0] = y
        w, bias = toxicity.fit_nnpu(sparse(x[y][:known]), sparse(x), features, 0.3)
        s = 1 / (1 + np.exp(-(x @ w + bias)))
        return y, s, -np.log(1 - s), w

    y, s, lost, w = fitted(400, 300, 20)
    assert lost.mean() - 0.3 * lost[y][:20].mean() > -0.1 and np.abs(w).max() < 50
    y, s, _, w = fitted(3000, 50, 300)
    assert w[0] == w.max() and ((s > 0.7) == y).mean() > 0.99


def test_awkward_rows(spark):
    df = awkward(spark)
    model = toxicity.train(df, labels(spark))
    out = toxicity.score(df, model)
    assert out.count() == len(ROWS) and out.filter("score < 0 or score > 1 or score is null").count() == 0
    kept = toxicity.drop_toxic(df, labels(spark))
    assert kept.schema == df.schema


def test_no_labels_and_empty_table(spark):
    df = awkward(spark)
    assert toxicity.drop_toxic(df, labels(spark).limit(0)).count() == len(ROWS)
    assert toxicity.drop_toxic(empty(spark), labels(spark)).count() == 0


def test_features_are_chosen_by_counts_over_all_texts(spark):
    d = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    toxic = {r.doc_id for r in known.collect() if r.toxic == 1}
    rows = [(r.doc_id in toxic, toxicity.text_features(r.text)) for r in docs.collect() if not held(r.doc_id)]
    n, m, p, u = sum(y for y, _ in rows), len(rows), {}, {}
    for y, found in rows:
        for f in found:
            u[f] = u.get(f, 0) + 1
            p[f] = p.get(f, 0) + y

    def z(f):
        rate = (p[f] + u[f]) / (n + m)
        return (p[f] / n - u[f] / m) / np.sqrt(rate * (1 - rate) * (1 / n + 1 / m) + 1e-9)

    want = sorted((f for f in p if p[f] >= toxicity.MIN_COUNT and z(f) > 0), key=lambda f: (-z(f), f))[:40]
    got = toxicity.train(docs, known, max_unlabelled=30, features=40)
    assert len(want) == 40 and sorted(got.weights) == sorted(want)


def test_labels_of_absent_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, ("vile filth words" if i % 5 == 0 else "calm plain words") + f" number {i % 11}") for i in range(300)],
                                 "doc_id long, text string")
    here = labels(spark, [(i, 1, int(i % 5 == 0)) for i in range(300)])
    gone = labels(spark, [(i, 0, 0) for i in range(1000, 4000)])
    assert toxicity.train(docs, here) == toxicity.train(docs, here.union(gone))
