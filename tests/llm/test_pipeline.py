import corpus_pipeline
from atoflow.llm import importance, packing, toxicity

from .helpers import awkward, labels
from .test_chunks import plain as plain_exact
from .test_simhash import plain as plain_near

SF = "/root/testdata/sf0.01"


def test_run_equals_the_plain_stages(spark):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in importance.resample(docs, known).filter("kept").collect()}
    left = docs.filter(docs.doc_id.isin(*good)).cache()
    calm = {r.doc_id: r.text for r in toxicity.score(left, toxicity.train(left, known)).filter("score < 0.7").collect()}
    exact = {keep for _, keep, _, _ in plain_exact(list(calm.items()))}
    near = {c for _, _, c in plain_near([(i, calm[i]) for i in sorted(exact)])}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out["doc_id"]) == near and 0 < len(near) <= len(exact) < len(calm) < len(good) < docs.count()
    assert out["n_tokens"].sum() == sum(len(calm[i].split()) for i in near)
    assert (out.groupby("bin")["n_tokens"].sum() <= out.groupby("bin")["capacity"].first()).all()


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = awkward(spark)
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema, name
        assert out.count() > 0 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
