import duckdb
import pytest

from atoflow.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    lines = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).astype(str).itertuples(index=False, name=None)))
    assert lines(got) == lines(want)


CONTRACT = {
    "op4_document_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op7_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op8_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op12_conversation_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_conversation_structure_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns[:len(CONTRACT[name])] == CONTRACT[name]
