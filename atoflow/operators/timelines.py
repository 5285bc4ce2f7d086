"""Time series: monthly acts, adaptive government timeline, gap-filled government series,
returns by time bucket, mobility rates and the returns summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import rotulo_representante_curto
from ..functions.text import ptbr_int, split_once, ustrip
from ..session import materialize


def acts_by_month(df: DataFrame) -> DataFrame:
    """(mes, tipo_ato, quantidade); ``mes`` is the first day of the month."""
    base = df.filter(F.col("data_movimentacao").isNotNull() & F.col("tipo_ato").isNotNull())
    return (base.withColumn("mes", F.trunc("data_movimentacao", "MM"))
                .groupBy("mes", "tipo_ato").agg(F.count(F.lit(1)).alias("quantidade")))


def government_timeline(df: DataFrame, grain: str = "auto") -> DataFrame:
    """(periodo, representante_origem, tipo_ato, quantidade).

    ``grain='month'``: periodo = month end (date), current month -> latest date + 1 day.
    ``grain='year'``: periodo = year (int).  ``grain='auto'``: month when the slice has at most
    three distinct representatives, else year.  The type of periodo depends on that, so the monthly
    counts are written to a table, and both the choice and the result are read from it.
    """
    base = df.filter(F.col("data_movimentacao").isNotNull())
    keys = ["representante_origem", "tipo_ato"]
    known = F.col("representante_origem").isNotNull() & F.col("tipo_ato").isNotNull()
    if grain == "year":
        return (base.filter(known).withColumn("periodo", F.year("data_movimentacao"))
                    .groupBy("periodo", *keys).agg(F.count(F.lit(1)).alias("quantidade")))
    # rows without a label or type count 0 but take part in the latest date, so one table of counts
    # serves both; each branch reads all its columns, so that its exchange is reused
    counts = base.groupBy(F.trunc("data_movimentacao", "MM").alias("mes"), *keys).agg(
        F.count_if(known).alias("quantidade"), F.max("data_movimentacao").alias("ultima"))
    if grain == "auto":
        counts = materialize(counts, "counts")
        if counts.agg(F.countDistinct("representante_origem").alias("n")).first()["n"] > K.ADAPTIVE_MONTH_MAX_GROUPS:
            return (counts.filter(F.col("quantidade") > 0).groupBy(F.year("mes").alias("periodo"), *keys)
                          .agg(F.sum("quantidade").alias("quantidade")))
    latest = counts.filter("quantidade >= 0").agg(F.max("ultima").alias("m")).select("m").scalar()
    shown = counts.filter(F.col("ultima").isNotNull() & (F.col("quantidade") > 0))
    end = F.when(F.col("mes") == F.trunc(latest, "MM"), F.date_add(latest, 1)).otherwise(F.last_day("mes"))
    return shown.select(end.alias("periodo"), *keys, "quantidade")


def _first_seen(seen: str, value: str) -> Column:
    """Distinct non-empty ``value`` fields of an array in order of position, joined by ' / '."""
    values = F.transform(F.array_sort(seen), lambda x: x[value])
    text = F.array_join(F.array_distinct(F.filter(values, lambda v: v != "")), " / ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(K.NAO_IDENTIFICADO))


def government_series(df: DataFrame) -> DataFrame:
    """Monthly series per (representante_governo, tipo_ato) for appointments and dismissals,
    gap-filled between each series' own first and last month.

    Columns: periodo, representante_governo, tipo_ato, quantidade (null in gap months),
    quantidade_sinal, papeis (roles in first-seen order, '' in gaps), origem (first-seen origins;
    carried into gaps), rotulo_serie, total_governo (order key: larger first), max_quantidade.

    The rows are reduced to (month, representative, type, role, origin) counts with the first
    position of each combination, then to one row per month, representative and type; totals and
    the next month of a series come from windows over those rows, and a row is repeated for the
    months up to its successor.  Rows without date, representative or type count 0 and only
    take part in the axis mode.
    """
    known = F.col("data_movimentacao").isNotNull() & F.col("representante_governo").isNotNull() & F.col("tipo_ato").isNotNull()
    keys = ["periodo", "representante_governo", "tipo_ato"]
    _, tail = split_once("governador_edicao", " - ")
    base = df.withColumns({"periodo": F.trunc("data_movimentacao", "MM"),
                           "papel": ustrip(F.coalesce(tail, F.col("governador_edicao"))), "origem": F.col("origem_representante")})
    combos = base.groupBy(*keys, "papel", "origem").agg(
        F.count_if(known).alias("n"), F.min(F.struct("data_movimentacao", "mov_id")).alias("pos"))
    months = combos.groupBy(*keys).agg(
        F.sum("n").alias("quantidade"), F.collect_list(F.struct("pos", "papel", "origem")).alias("vistos"),
        F.bool_and(F.when(F.col("origem").isNotNull(), F.col("origem") == K.EIXO_SETOR)).alias("setor"))
    # the condition holds for every row; with it the subquery reads the same columns as the main
    # branch and reuses its exchange
    whole = months.filter(F.size("vistos") > 0).agg(F.struct(
        F.max("quantidade").alias("max"), F.bool_and("setor").alias("setor")).alias("t")).select("t").scalar()

    serie = months.filter((F.col("quantidade") > 0)).select(
        *keys, "quantidade", _first_seen("vistos", "papel").alias("papeis"), _first_seen("vistos", "origem").alias("origem"))
    rep = Window.partitionBy("representante_governo")
    one = Window.partitionBy("representante_governo", "tipo_ato").orderBy("periodo")
    rows = (serie.withColumns({"total_governo": F.sum("quantidade").over(rep),
                               "origem_governo": F.min_by("origem", F.struct("tipo_ato", "periodo")).over(rep)})
                 .filter(F.col("tipo_ato").isin(K.NOMEACAO, K.EXONERACAO))
                 .withColumn("seguinte", F.lead("periodo").over(one)))
    last = F.coalesce(F.add_months("seguinte", -1), F.col("periodo"))
    filled = rows.select(F.posexplode(F.sequence("periodo", last, F.expr("INTERVAL 1 MONTH"))).alias("pos", "mes"), "*")
    here = lambda c, gap: F.when(F.col("pos") == 0, F.col(c)).otherwise(gap)
    filled = filled.withColumn("quantidade", here("quantidade", F.lit(None)))
    return filled.select(
        F.col("mes").alias("periodo"), "representante_governo", "tipo_ato", "quantidade",
        F.when(F.col("tipo_ato") == K.EXONERACAO, -F.col("quantidade")).otherwise(F.col("quantidade"))
        .alias("quantidade_sinal"),
        here("papeis", F.lit("")).alias("papeis"),
        here("origem", F.col("origem_governo")).alias("origem"),
        F.when(whole["setor"], F.col("representante_governo"))
        .otherwise(F.concat(rotulo_representante_curto("representante_governo"), F.lit(" ("),
                            F.col("origem_governo"), F.lit(")"))).alias("rotulo_serie"),
        "total_governo",
        whole["max"].alias("max_quantidade"),
    )


def returns_timeline(ret_c: DataFrame) -> DataFrame:
    """(ano, tempo_cluster, eventos)."""
    return (ret_c.filter(F.col("ano").isNotNull() & F.col("tempo_cluster").isNotNull())
                 .groupBy("ano", "tempo_cluster").agg(F.count(F.lit(1)).alias("eventos")))


def mobility_timeline(ret_c: DataFrame) -> DataFrame:
    """Per year: total (non-null people), mudou_cargo, mudou_orgao (flag sums) and the two rates."""
    agg = (ret_c.filter(F.col("ano").isNotNull())
                .groupBy("ano").agg(F.count("pessoa").alias("total"),
                                    F.sum(F.col("mudou_cargo").cast("long")).alias("mudou_cargo"),
                                    F.sum(F.col("mudou_orgao").cast("long")).alias("mudou_orgao")))
    return (agg.withColumn("tx_mudou_cargo", F.try_divide(F.col("mudou_cargo").cast("double"), F.col("total")))
               .withColumn("tx_mudou_orgao", F.try_divide(F.col("mudou_orgao").cast("double"), F.col("total"))))


def returns_summary(ret_c: DataFrame) -> DataFrame:
    """One row: registros, pessoas, media_dias, mediana_dias (exact), tx_mudou_cargo, tx_mudou_orgao."""
    return ret_c.agg(
        F.count(F.lit(1)).alias("registros"),
        F.countDistinct("pessoa").alias("pessoas"),
        F.avg(F.col("dias_desde_exoneracao").cast("double")).alias("media_dias"),
        F.median(F.col("dias_desde_exoneracao").cast("double")).alias("mediana_dias"),
        F.avg(F.col("mudou_cargo").cast("double")).alias("tx_mudou_cargo"),
        F.avg(F.col("mudou_orgao").cast("double")).alias("tx_mudou_orgao"),
    )


def returns_report(ret_c: DataFrame, trans: DataFrame, steady: DataFrame, top_k: int = K.TOP_N_RESUMO) -> DataFrame:
    """The returns summary as text lines: (secao, ordem, linha), blank and heading lines included.

    Sections in reading order: 'resumo' (title, counts, mean and median days with two decimals,
    'nan' where no row has days, change rates as percentages), 'transicoes' (top-k edges
    'a → b: n'), 'estacionario' ('state: p' with four decimals, by p descending, or the line that it
    cannot be computed).  No rows give one line that says so.
    """
    s = returns_summary(ret_c).withColumn("estados", steady.agg(F.count(F.lit(1)).alias("c")).select("c").scalar())
    fixed = lambda c: F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))
    days = lambda c: F.concat(F.coalesce(F.when(~F.isnan(c), fixed(F.col(c))), F.lit("nan")), F.lit(" dias"))
    pct = lambda c: F.concat(fixed(F.col(c) * 100), F.lit("%"))
    line = lambda secao, ordem, text: F.struct(
        F.lit(secao).alias("secao"), F.lit(ordem).alias("ordem"), text.alias("linha"))
    resumo = [
        F.lit(K.TITULO_RESUMO), F.lit(""),
        F.concat(F.lit("Registros filtrados: "), ptbr_int("registros")),
        F.concat(F.lit("Pessoas únicas: "), ptbr_int("pessoas")),
        F.concat(F.lit("Tempo médio de retorno: "), days("media_dias")),
        F.concat(F.lit("Mediana do retorno: "), days("mediana_dias")),
        F.concat(F.lit("Taxa de mudança de cargo: "), pct("tx_mudou_cargo")),
        F.concat(F.lit("Taxa de mudança de órgão: "), pct("tx_mudou_orgao")),
        F.lit("")]
    lines = [line("resumo", i, t) for i, t in enumerate(resumo, 1)]
    lines += [line("transicoes", 1, F.lit(K.TITULO_TRANSICOES)),
              line("estacionario", 1, F.lit("")), line("estacionario", 2, F.lit(K.TITULO_ESTACIONARIO))]
    no_steady = F.array(line("estacionario", 3, F.lit(K.NAO_CALCULAVEL)))
    shown = F.when(F.col("registros") == 0, F.array(line("resumo", 1, F.lit(K.SEM_DADOS)))).when(
        F.col("estados") == 0, F.concat(F.array(*lines), no_steady)).otherwise(F.array(*lines))
    stats = s.select(F.inline(shown))
    order = [F.desc("n"), F.asc("evento"), F.asc("prox_evento")]
    top = trans.orderBy(*order).limit(top_k)
    tops = top.select(F.lit("transicoes").alias("secao"), (F.row_number().over(Window.orderBy(*order)) + 1).alias("ordem"),
                      F.concat_ws("", "evento", F.lit(" → "), "prox_evento", F.lit(": "), F.col("n").cast("string"))
                      .alias("linha"))
    st_order = [F.desc("prob"), F.asc("evento")]
    sts = steady.select(F.lit("estacionario").alias("secao"),
                        (F.row_number().over(Window.orderBy(*st_order)) + 2).alias("ordem"),
                        F.concat("evento", F.lit(": "), F.format_number(F.col("prob"), 4)).alias("linha"))
    return stats.unionByName(tops).unionByName(sts)
