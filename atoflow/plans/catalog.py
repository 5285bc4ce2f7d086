"""Registered queries: name -> (spark plan builder, oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables under ``sf_dir`` (whole tables)
and returns a lazy DataFrame.  Column names equal the oracle's; rank/sort positions are exposed
as columns because results are compared without order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import rotulo_governo_curto, rotulo_representante_curto
from ..operators import agencies, flows, kpis, markov, timelines, transitions
from ..operators.cleanse import clean_movements, clean_returns
from ..operators.filters import Filters, filter_choices, representative_choices, slice_raw
from ..session import materialize
from ..operators.roles import document_roles
from ..sources import fixtures, states
from ..sources.tables import table
from . import oracle as O

Builder = Callable[[SparkSession, str], DataFrame]

# The dashboard slice exercised by ``filter_slice`` (the operator under test is the filter).
SLICE = Filters(estado="EUROPE", anos=(1996, 1997, 1998),
                representantes=("Sergio Cabral (Executivo estadual)", "Rodrigo Bacellar (ALERJ)",
                                "Nao identificado (Nao identificado)"),
                autorias=(K.AUTORIA_GOVERNADOR, K.AUTORIA_SECRETARIA),
                orgaos=("NATION_3 - DEPTO", "NATION_8-Depto", "NATION_13 / SUB", "nation_18  -depto", "NATION_18 - DEPTO"),
                tipos=(K.NOMEACAO, K.EXONERACAO))


# Three representatives: the adaptive timeline is monthly.
FEW = ("Sergio Cabral (Executivo estadual)", "Rodrigo Bacellar (ALERJ)", "Nao identificado (Nao identificado)")

# The representative filter's state and current selection exercised by ``representative_choices``.
CHOICE_STATE = "AMERICA"
CHOICE_SELECTED = ("Sergio Cabral (Executivo estadual)", "Ninguem (Nao identificado)")


def mov_c(spark: SparkSession, sf: str) -> DataFrame:
    return clean_movements(fixtures.movements(spark, sf))


def ret_c(spark: SparkSession, sf: str) -> DataFrame:
    return clean_returns(fixtures.returns(spark, sf))


def _ret_trans(spark, sf):
    return transitions.transitions(transitions.event_sequence(ret_c(spark, sf)))


def _event_trans(spark, sf):
    return transitions.transitions(transitions.user_event_sequence(table(spark, sf, "events")))


def _steady(trans: DataFrame) -> DataFrame:
    return markov.steady_state(trans)


def _returns_report(spark, sf):
    trans = materialize(_ret_trans(spark, sf), "transitions")
    return timelines.returns_report(ret_c(spark, sf), trans, markov.steady_state(trans))


def _representative_choices(spark, sf):
    options, _ = representative_choices(mov_c(spark, sf), CHOICE_STATE, CHOICE_SELECTED)
    return options.withColumn("selecionado", F.col("valor").isin(*CHOICE_SELECTED))


def _short_labels(spark, sf):
    g = mov_c(spark, sf).select("governador_edicao", "representante_governo").distinct()
    return g.select("governador_edicao", "representante_governo",
                    rotulo_representante_curto("representante_governo").alias("rotulo_curto"),
                    rotulo_governo_curto("governador_edicao").alias("rotulo_governo_curto"))


def _agencies_as_sectors(spark, sf):
    """All movements with the agency in the representative's place, so that every origin is a sector."""
    return mov_c(spark, sf).withColumns({"representante_origem": F.col("orgao"), "origem_representante": F.lit(K.EIXO_SETOR)})


def _scan_states(spark, sf):
    """Both cleaned tables read back from per-state folders (two files each, one state incomplete)."""
    ret, mov = states.reload(spark, fixtures.state_folders(spark, sf))
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    common = ["estado", "pessoa", "tipo_ato", "orgao", "autoridade_assinante", "ano", "representante_origem"]
    return mov.select(F.lit("movimentacoes").alias("tabela"), *common, F.col("data_movimentacao").alias("data"),
                      *none("date", "data_exoneracao"), *none("int", "dias_desde_exoneracao"), *none("string", "estado_N")).unionByName(
        ret.select(F.lit("retornos").alias("tabela"), *common, F.col("data_nomeacao").alias("data"),
                   "data_exoneracao", "dias_desde_exoneracao", "estado_N"))


def _round(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


SPARK: dict[str, Builder] = {
    "clean_movements": mov_c,
    "classify_returns": ret_c,
    "filter_slice": lambda s, sf: slice_raw(fixtures.movements(s, sf), SLICE),
    "filter_choices": lambda s, sf: filter_choices(mov_c(s, sf), ret_c(s, sf)),
    "representative_choices": _representative_choices,
    "kpi_cards": lambda s, sf: kpis.kpi_cards(mov_c(s, sf)),
    "kpi_cards_slice": lambda s, sf: kpis.kpi_cards(slice_raw(fixtures.movements(s, sf), SLICE)),
    "slice_reading": lambda s, sf: kpis.slice_reading(mov_c(s, sf)),
    "period_label": lambda s, sf: kpis.period_label(mov_c(s, sf), by=["estado"]),
    "acts_by_year": lambda s, sf: flows.acts_by_year(mov_c(s, sf)),
    "acts_by_month": lambda s, sf: timelines.acts_by_month(mov_c(s, sf)),
    "agency_labels": lambda s, sf: agencies.agency_labels(agencies.with_agency_key(mov_c(s, sf))),
    "agency_flow_top10": lambda s, sf: agencies.agency_flow_top(mov_c(s, sf)),
    "government_flow": lambda s, sf: flows.government_flow(mov_c(s, sf)),
    "government_flow_dense": lambda s, sf: flows.government_flow_dense(mov_c(s, sf)),
    "government_balance": lambda s, sf: flows.government_balance(mov_c(s, sf)),
    "sector_flow_top10": lambda s, sf: flows.government_flow(mov_c(s, sf), eixo=K.EIXO_SETOR),
    "sector_balance_top10": lambda s, sf: flows.government_balance(mov_c(s, sf), eixo=K.EIXO_SETOR),
    "government_summary": lambda s, sf: flows.government_summary(mov_c(s, sf)),
    "government_timeline_year": lambda s, sf: timelines.government_timeline(mov_c(s, sf), grain="year"),
    "government_timeline_month": lambda s, sf: timelines.government_timeline(mov_c(s, sf), grain="month"),
    "government_series": lambda s, sf: timelines.government_series(mov_c(s, sf)),
    "returns_timeline": lambda s, sf: timelines.returns_timeline(ret_c(s, sf)),
    "mobility_timeline": lambda s, sf: _round(timelines.mobility_timeline(ret_c(s, sf)),
                                              ["tx_mudou_cargo", "tx_mudou_orgao"]),
    "returns_summary": lambda s, sf: _round(timelines.returns_summary(ret_c(s, sf)),
                                            ["media_dias", "mediana_dias", "tx_mudou_cargo", "tx_mudou_orgao"]),
    "event_sequence": lambda s, sf: transitions.event_sequence(ret_c(s, sf)).select(
        "pessoa", "data", "evento", "prox_evento", "mov_id", "ord"),
    "transitions": _ret_trans,
    "event_transitions": _event_trans,
    "transitions_top30": lambda s, sf: transitions.top_transitions(_ret_trans(s, sf)),
    "transitions_by_year_top30": lambda s, sf: transitions.transitions_by_year(ret_c(s, sf)),
    "transition_matrix": lambda s, sf: _round(transitions.transition_matrix(_ret_trans(s, sf)), ["p"]),
    "event_transition_matrix": lambda s, sf: _round(transitions.transition_matrix(_event_trans(s, sf)), ["p"]),
    "steady_state": lambda s, sf: _steady(_event_trans(s, sf)),
    "returns_steady_state": lambda s, sf: _steady(_ret_trans(s, sf)),
    "returns_report": _returns_report,
    "sankey_edges": lambda s, sf: transitions.sankey_edges(_ret_trans(s, sf)),
    "node_degree": lambda s, sf: transitions.node_degree(_ret_trans(s, sf)),
    "short_labels": _short_labels,
    "document_roles": lambda s, sf: document_roles(fixtures.gazette(s, sf)),
    "scan_states": _scan_states,
    "sector_flow_auto": lambda s, sf: flows.government_flow(_agencies_as_sectors(s, sf)),
    "sector_balance_auto": lambda s, sf: flows.government_balance(_agencies_as_sectors(s, sf)),
    "government_timeline_few": lambda s, sf: timelines.government_timeline(
        slice_raw(fixtures.movements(s, sf), Filters(representantes=FEW)), grain="auto"),
}
