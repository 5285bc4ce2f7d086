"""An empty slice gives empty results with the full schema (one zero row for the KPI cards)."""

from pyspark.sql import functions as F

from atoflow.operators import agencies, flows, kpis, timelines
from atoflow.operators.filters import Filters, slice_movements
from atoflow.plans import catalog

from .conftest import SF_SMALL


def test_empty_slice(spark):
    mov = slice_movements(catalog.mov_c(spark, SF_SMALL), Filters(estado="NOWHERE"))
    k = kpis.kpi_cards(mov).collect()
    assert len(k) == 1 and k[0]["atos"] == 0 and k[0]["pessoas"] == 0
    r = kpis.slice_reading(mov).first()
    assert r["periodo"] == "sem periodo" and r["governo_top"] == "Nao identificado" and r["orgao_top_total"] == 0
    for op in (flows.government_flow, flows.government_balance, flows.government_summary, flows.acts_by_year,
               timelines.acts_by_month, timelines.government_series, agencies.agency_flow_top):
        out = op(mov)
        assert out.count() == 0, op.__name__
        assert len(out.columns) > 0
    assert timelines.government_timeline(mov, grain="month").count() == 0
    assert timelines.government_timeline(mov, grain="auto").count() == 0


def test_empty_report(spark):
    ret = catalog.ret_c(spark, SF_SMALL).filter("false")
    none = spark.createDataFrame([], "evento string, prox_evento string, n long")
    steady = spark.createDataFrame([], "evento string, prob double")
    lines = timelines.returns_report(ret, none, steady).collect()
    assert [r["linha"] for r in lines] == ["Sem dados para os filtros selecionados."]


def test_report_without_steady_state(spark):
    ret = catalog.ret_c(spark, SF_SMALL).limit(5).withColumn("dias_desde_exoneracao", F.lit(None).cast("int"))
    none = spark.createDataFrame([], "evento string, prox_evento string, n long")
    steady = spark.createDataFrame([], "evento string, prob double")
    lines = {(r["secao"], r["ordem"]): r["linha"] for r in timelines.returns_report(ret, none, steady).collect()}
    assert lines["resumo", 5] == "Tempo médio de retorno: nan dias"
    assert lines["estacionario", 3] == "Não calculável para o filtro atual."
