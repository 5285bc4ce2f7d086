"""Headline numbers of a slice: KPI cards, the slice reading, period texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import periodo_anos, periodo_min_max
from ..functions.text import ptbr_int, ustrip


CARDS = ["atos", "atos_governador", "atos_secretarias", "exoneracoes", "nomeacoes", "saldo", "pessoas"]


def kpi_cards(df: DataFrame) -> DataFrame:
    """One row: atos, atos_governador, atos_secretarias, exoneracoes, nomeacoes, saldo, pessoas, and the
    text of each (``_txt``, pt-BR thousands)."""
    row = df.agg(
        F.count(F.lit(1)).alias("atos"),
        F.count_if(F.col("autoria_ato") == K.AUTORIA_GOVERNADOR).alias("atos_governador"),
        F.count_if(F.col("autoria_ato") == K.AUTORIA_SECRETARIA).alias("atos_secretarias"),
        F.count_if(F.col("tipo_ato") == K.EXONERACAO).alias("exoneracoes"),
        F.count_if(F.col("tipo_ato") == K.NOMEACAO).alias("nomeacoes"),
        F.countDistinct("pessoa").alias("pessoas"),
    )
    row = row.withColumn("saldo", F.col("nomeacoes") - F.col("exoneracoes"))
    return row.select(*CARDS, *(ptbr_int(c).alias(f"{c}_txt") for c in CARDS))


def _top1(counts: DataFrame, label: str) -> DataFrame:
    """Most frequent label; ties -> smallest label.  ``TakeOrderedAndProject``: no global sort."""
    return counts.orderBy(F.desc("n"), F.asc(label)).limit(1)


def slice_reading(df: DataFrame) -> DataFrame:
    """One row: periodo (min-max years), registros, pessoas, governo_top, governo_top_total,
    orgao_top, orgao_top_total (stripped raw agency), saldo, direcao, and the pt-BR texts.

    The slice is read into one (representative, agency, type, year) count table, partially
    aggregated map-side; totals, balance, years and both top-1 values come from it (its exchange
    is reused by each branch).  Only the distinct-people count reads the slice separately."""
    org = ustrip("orgao")
    c = (df.select("representante_origem", F.when(org != "", org).alias("orgao_top"), "tipo_ato", "ano")
           .groupBy("representante_origem", "orgao_top", "tipo_ato", "ano").agg(F.count(F.lit(1)).alias("n")))
    gov = (c.filter(F.col("representante_origem").isNotNull())
            .groupBy("representante_origem").agg(F.sum("n").alias("n")))
    orgs = c.filter(F.col("orgao_top").isNotNull()).groupBy("orgao_top").agg(F.sum("n").alias("n"))
    gov1 = _top1(gov, "representante_origem").select(
        F.struct(F.col("representante_origem").alias("l"), "n")).scalar()  # one subquery each
    org1 = _top1(orgs, "orgao_top").select(F.struct(F.col("orgao_top").alias("l"), "n")).scalar()
    pessoas = df.agg(F.countDistinct("pessoa").alias("p")).select("p").scalar()
    base = c.agg(
        F.collect_set("ano").alias("anos"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("registros"),
        (F.coalesce(F.sum(F.when(F.col("tipo_ato") == K.NOMEACAO, F.col("n"))), F.lit(0))
         - F.coalesce(F.sum(F.when(F.col("tipo_ato") == K.EXONERACAO, F.col("n"))), F.lit(0))).alias("saldo"),
    )
    out = base.select(
        periodo_min_max("anos").alias("periodo"), "registros", pessoas.alias("pessoas"),
        F.coalesce(gov1["l"], F.lit(K.NAO_IDENTIFICADO)).alias("governo_top"),
        F.coalesce(gov1["n"], F.lit(0)).alias("governo_top_total"),
        F.coalesce(org1["l"], F.lit(K.NAO_IDENTIFICADO)).alias("orgao_top"),
        F.coalesce(org1["n"], F.lit(0)).alias("orgao_top_total"),
        "saldo",
        F.when(F.col("saldo") >= 0, F.lit(K.DIRECAO_ENTRADAS)).otherwise(F.lit(K.DIRECAO_SAIDAS)).alias("direcao"),
    )
    # the thousands mark is exchanged in the whole item, so a comma in a name becomes a point too
    item = lambda name, n: F.replace(F.concat(name, F.lit(" ("), F.format_number(n, 0), F.lit(")")), F.lit(","), F.lit("."))
    return out.withColumns({
        "registros_txt": ptbr_int("registros"),
        "pessoas_txt": ptbr_int("pessoas"),
        "governo_top_txt": item(F.col("governo_top"), F.col("governo_top_total")),
        "orgao_top_txt": item(F.col("orgao_top"), F.col("orgao_top_total")),
        "saldo_txt": F.concat(ptbr_int("saldo"), F.lit(" ("), F.col("direcao"), F.lit(")")),
    })


def period_label(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Year-set text per group ('Y', 'A-B' when contiguous, 'A, B, D' with gaps)."""
    by = by or []
    agg = df.groupBy(*by).agg(F.collect_set("ano").alias("anos")) if by else df.agg(F.collect_set("ano").alias("anos"))
    return agg.select(*by, periodo_anos("anos").alias("periodo"))
