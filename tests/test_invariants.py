
from pyspark.sql import functions as F

from atoflow.operators import flows, kpis, timelines, transitions
from atoflow.plans import catalog

from .conftest import SF_SMALL


def test_counts_add_up(spark):
    mov = catalog.mov_c(spark, SF_SMALL)
    k = kpis.kpi_cards(mov).first()
    by_type = {r["tipo_ato"]: r["n"] for r in mov.groupBy("tipo_ato").agg(F.count("*").alias("n")).collect()}
    assert k["atos"] == sum(by_type.values()) == mov.count()
    assert k["saldo"] == k["nomeacoes"] - k["exoneracoes"]
    s = flows.government_summary(mov).collect()
    assert all(r["atos"] == r["nomeacao"] + r["exoneracao"] for r in s)
    assert sum(r["atos"] for r in s) == k["nomeacoes"] + k["exoneracoes"]


def test_matrix_rows_and_transition_total(spark):
    ret = catalog.ret_c(spark, SF_SMALL)
    seq = transitions.event_sequence(ret)
    trans = transitions.transitions(seq)
    per_person = seq.groupBy("pessoa").agg(F.count("*").alias("k"))
    expected = per_person.agg(F.sum(F.col("k") - 1)).first()[0]
    assert trans.agg(F.sum("n")).first()[0] == expected
    m = transitions.transition_matrix(trans)
    for r in m.groupBy("evento").agg(F.sum("p").alias("s")).collect():
        assert abs(r["s"] - 1.0) < 1e-9 or r["s"] == 0.0
    n_states = transitions.states(trans).count()
    assert m.count() == n_states * n_states


def test_series_months_are_contiguous(spark):
    mov = catalog.mov_c(spark, SF_SMALL)
    s = timelines.government_series(mov)
    spans = s.groupBy("representante_governo", "tipo_ato").agg(
        F.count("*").alias("n"), F.min("periodo").alias("lo"), F.max("periodo").alias("hi"))
    for r in spans.collect():
        months = (r["hi"].year - r["lo"].year) * 12 + r["hi"].month - r["lo"].month + 1
        assert r["n"] == months
    assert set(r[0] for r in s.select("tipo_ato").distinct().collect()) <= {"nomeacao", "exoneracao"}


def test_rows_carry_their_canonical_agency_label(spark):
    from atoflow.operators import agencies

    mov = catalog.mov_c(spark, SF_SMALL)
    labelled = agencies.with_agency_label(mov)
    labels = {r["orgao_chave"]: r["orgao_grafico"]
              for r in agencies.agency_labels(agencies.with_agency_key(mov)).collect()}
    rows = labelled.select("orgao_chave", "orgao_grafico").distinct().collect()
    assert rows and all(labels[r["orgao_chave"]] == r["orgao_grafico"] for r in rows)
    assert labelled.count() == agencies.with_agency_key(mov).count()
