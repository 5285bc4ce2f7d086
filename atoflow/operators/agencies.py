"""Agency canonicalisation (key + most frequent spelling) and the top-agency flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.agency import orgao_chave, orgao_rotulo, orgao_utilizavel
from ..functions.text import ptbr_int
from .flows import signed


def with_agency_key(df: DataFrame) -> DataFrame:
    """Add ``orgao_rotulo`` and ``orgao_chave``; rows without an agency are dropped.

    The drop tests the raw text (``orgao_utilizavel``), so the pushed-down filter does not
    evaluate the label and key regexes a second time; label and key share one projection."""
    rot = orgao_rotulo("orgao")
    return df.filter(orgao_utilizavel("orgao")).withColumns({"orgao_rotulo": rot, "orgao_chave": orgao_chave(rot)})


def agency_labels(keyed: DataFrame) -> DataFrame:
    """Per key: ``orgao_grafico`` = most frequent spelling (ties -> alphabetical), ``n_atos``.

    Two partial aggregations; the pick is ``min_by(label, (-count, label))`` — no window, no sort.
    """
    spell = keyed.groupBy("orgao_chave", "orgao_rotulo").agg(F.count(F.lit(1)).alias("n"))
    return spell.groupBy("orgao_chave").agg(
        F.min_by("orgao_rotulo", F.struct((-F.col("n")).alias("m"), F.col("orgao_rotulo"))).alias("orgao_grafico"),
        F.sum("n").alias("n_atos"))


def with_agency_label(df: DataFrame) -> DataFrame:
    """Rows with a usable agency, plus orgao_chave and the canonical ``orgao_grafico``."""
    keyed = with_agency_key(df)
    labels = agency_labels(keyed).select("orgao_chave", "orgao_grafico")
    return keyed.join(labels, "orgao_chave", "inner")


def agency_flow_top(df: DataFrame, k: int = K.TOP_N_ORGAOS) -> DataFrame:
    """In/out flow of the k agencies with most acts (ties -> key): (orgao_chave, orgao_grafico,
    tipo_ato, quantidade, fluxo, rotulo, peso_ordem, ranking).

    Rows without an act type count for the ranking and the label but have no bar.

    The rows are read once into (key, spelling, type) counts — partially aggregated map-side, so
    the shuffle carries at most one row per distinct triple per task.  Ranking (a k-row
    ``TakeOrderedAndProject``), canonical labels and per-type bars are all derived from that small
    table; the k-row ranking is broadcast (bounded by k).
    """
    keyed = with_agency_key(df)
    c3 = keyed.groupBy("orgao_chave", "orgao_rotulo", "tipo_ato").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("orgao_chave")]
    ranking = c3.groupBy("orgao_chave").agg(F.sum("n").alias("n")).orderBy(*order).limit(k)
    ranking = F.broadcast(ranking.withColumn("ranking", F.row_number().over(Window.orderBy(*order)))
                          .select("orgao_chave", "ranking"))
    top = c3.join(ranking, "orgao_chave")
    spell = top.groupBy("orgao_chave", "orgao_rotulo").agg(F.sum("n").alias("n"))
    labels = spell.groupBy("orgao_chave").agg(
        F.min_by("orgao_rotulo", F.struct((-F.col("n")).alias("m"), F.col("orgao_rotulo"))).alias("orgao_grafico"))
    bars = top.filter(F.col("tipo_ato").isNotNull()).groupBy("orgao_chave", "ranking", "tipo_ato").agg(F.sum("n").alias("quantidade"))
    bars = (bars.join(labels, "orgao_chave")
                .withColumn("fluxo", signed("quantidade"))
                .withColumn("rotulo", ptbr_int("quantidade"))
                .withColumn("peso_ordem", F.sum(F.abs("fluxo")).over(Window.partitionBy("orgao_grafico"))))
    return bars.select("orgao_chave", "orgao_grafico", "tipo_ato", "quantidade", "fluxo", "rotulo",
                       "peso_ordem", "ranking")
