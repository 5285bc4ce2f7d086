import numpy as np
import pytest

from atoflow.llm import importance

from .helpers import ROWS, awkward, empty, labels, rows


@pytest.mark.parametrize("k", [1, 2, 7, 500, 1000])
def test_kth_largest_is_exact(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.integers(-2 ** 62, 2 ** 62, 500), rng.integers(-9, 9, 490), [5] * 10])
    df = spark.createDataFrame([(int(v),) for v in x], "key long")
    assert importance.kth_largest(df, "key", k) == sorted(x.tolist(), reverse=True)[k - 1]


def test_weights_equal_the_plain_version(spark):
    docs, known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in known.filter("quality = 1").collect()}
    hasher, raw, target = importance.Hasher(), np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    idx = {i: hasher(t).astype(int) for i, t in texts.items()}
    for i, b in idx.items():
        np.add.at(raw, b, 1)
        if i in good:
            np.add.at(target, b, 1)
    ratio = importance.log_ratio(target, raw)
    got = importance.resample(docs, known).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    np.testing.assert_allclose(got["log_weight"].loc[list(texts)], [ratio[idx[i]].sum() for i in texts], rtol=1e-9, atol=1e-9)
    share = len(good) / known.count()
    k = int((got["log_weight"] >= np.log(importance.POSTERIOR / share)).sum())
    assert got["kept"].sum() == k and got[got["kept"]]["noisy"].min() >= got[~got["kept"]]["noisy"].max()
    kept = importance.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(got.index[got["kept"]])


def test_noise_is_gumbel(spark):
    g = np.array([r.g for r in spark.range(20_000).select(importance.gumbel(importance.F.col("id")).alias("g")).collect()])
    assert abs(g.mean() - 0.5772) < 0.03 and abs(g.var() - np.pi ** 2 / 6) < 0.06


def test_good_texts_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    # judged on labels that the target model has not seen
    seen, unseen = known.filter("doc_id % 2 = 0"), known.filter("doc_id % 2 = 1")
    got = importance.resample(docs, seen).join(unseen, "doc_id").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.99 and got[got["quality"] == 0]["kept"].mean() < 0.1


def test_awkward_rows(spark):
    df = awkward(spark)
    out = importance.resample(df, labels(spark))
    assert out.count() == len(ROWS)
    weights = {r.doc_id: r.log_weight for r in out.collect()}
    assert weights[2] == weights[3] == weights[4] == 0.0
    kept = importance.keep_good(df, labels(spark))
    assert kept.schema == df.schema and kept.count() == out.filter("kept").count()


def test_without_labels_everything_stays(spark):
    df = awkward(spark)
    assert rows(importance.keep_good(df, labels(spark).limit(0)), "doc_id", "text") == rows(df, "doc_id", "text")


def test_empty_table(spark):
    assert importance.resample(empty(spark), labels(spark)).count() == 0
    assert importance.keep_good(empty(spark), labels(spark)).count() == 0
