"""In/out flows and balances by year, representative and act type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import ptbr_int


def signed(quantidade: Column | str, tipo: Column | str = "tipo_ato") -> Column:
    """Dismissals count negative, every other act type positive."""
    q = F.col(quantidade) if isinstance(quantidade, str) else quantidade
    t = F.col(tipo) if isinstance(tipo, str) else tipo
    return F.when(t == K.EXONERACAO, -q).otherwise(q)


def _kept(base: DataFrame, weight: str, eixo: str | None, k: int) -> DataFrame:
    """Rows of the small per-label table ``base`` that an axis shows: all, or in 'Setor' mode those of
    the ``k`` labels with the largest weight (ties: the later label).

    The mode follows from the origins counted with the labels (column ``setor``: whether all non-null
    origins are 'Setor'), so the movements are not read again; the ranking has one row a label.
    """
    one = base.agg(F.bool_and("setor").alias("s"))
    setor = F.lit(eixo == K.EIXO_SETOR) if eixo else F.coalesce(one.select("s").scalar(), F.lit(False))
    shown = base.filter(F.col("mostra")) if "mostra" in base.columns else base
    top = F.broadcast(_top_labels(shown.groupBy("representante_origem").agg(F.max(weight).alias(weight)),
                                  "representante_origem", weight, k))  # at most k rows
    return shown.join(top, "representante_origem", "left").filter(~setor | F.col("__top").isNotNull())


def _setor() -> Column:
    return F.bool_and(F.when(F.col("origem_representante").isNotNull(), F.col("origem_representante") == K.EIXO_SETOR)).alias("setor")


def acts_by_year(df: DataFrame) -> DataFrame:
    """(ano, tipo_ato, quantidade) over rows with a year."""
    return (df.filter(F.col("ano").isNotNull() & F.col("tipo_ato").isNotNull())
              .groupBy("ano", "tipo_ato").agg(F.count(F.lit(1)).alias("quantidade")))


def _top_labels(weights: DataFrame, label: str, weight: str, k: int) -> DataFrame:
    """The k labels that end a display order ascending by (weight, label)."""
    return weights.orderBy(F.desc(weight), F.desc(label)).limit(k).select(label, F.lit(True).alias("__top"))


def government_flow(df: DataFrame, eixo: str | None = None) -> DataFrame:
    """Signed flow per (representante_origem, tipo_ato) with the display-order weight
    ``peso_ordem`` (sum of |flow| of the label; ascending = bottom to top).  In 'Setor' mode only
    the ten heaviest labels are kept.  One pass over the movements."""
    base = df.groupBy("representante_origem", "tipo_ato").agg(F.count(F.lit(1)).alias("quantidade"), _setor())
    base = base.withColumn("mostra", F.col("representante_origem").isNotNull() & F.col("tipo_ato").isNotNull())
    base = (base.withColumn("fluxo", signed("quantidade"))
                .withColumn("rotulo", ptbr_int("quantidade"))
                .withColumn("peso_ordem", F.sum(F.when(F.col("mostra"), F.abs("fluxo"))).over(Window.partitionBy("representante_origem"))))
    return _kept(base, "peso_ordem", eixo, K.TOP_N_SETOR).select(
        "representante_origem", "tipo_ato", "quantidade", "fluxo", "rotulo", "peso_ordem")


def _type_counts(df: DataFrame, key: str) -> DataFrame:
    """Per key: exoneracao, nomeacao, whether it has a typed act (``mostra``), the axis flag (``setor``).

    A representative none of whose acts has a type forms no group and is not shown."""
    return df.groupBy(key).agg(
        F.count_if(F.col("tipo_ato") == K.EXONERACAO).alias("exoneracao"),
        F.count_if(F.col("tipo_ato") == K.NOMEACAO).alias("nomeacao"),
        (F.col(key).isNotNull() & (F.count("tipo_ato") > 0)).alias("mostra"), _setor())


def government_balance(df: DataFrame, eixo: str | None = None) -> DataFrame:
    """Per representante_origem: exoneracao, nomeacao, saldo (ascending = display order), cor,
    saldo_txt.  In 'Setor' mode only the ten largest |saldo| are kept.  One pass over the movements."""
    base = _type_counts(df, "representante_origem")
    base = (base.withColumn("saldo", F.col("nomeacao") - F.col("exoneracao"))
                .withColumn("cor", F.when(F.col("saldo") >= 0, F.lit(K.MAIS_ENTRADAS)).otherwise(F.lit(K.MAIS_SAIDAS)))
                .withColumn("saldo_txt", ptbr_int("saldo")).withColumn("absoluto", F.abs("saldo")))
    return _kept(base, "absoluto", eixo, K.TOP_N_SETOR).select(
        "representante_origem", "exoneracao", "nomeacao", "saldo", "cor", "saldo_txt")


def government_summary(df: DataFrame) -> DataFrame:
    """Per representante_origem: exoneracao, nomeacao, saldo, atos (= nomeacao + exoneracao);
    sorted by atos descending, then label."""
    base = _type_counts(df, "representante_origem").filter("mostra").drop("mostra", "setor")
    return (base.withColumn("saldo", F.col("nomeacao") - F.col("exoneracao"))
                .withColumn("atos", F.col("nomeacao") + F.col("exoneracao"))
                .orderBy(F.desc("atos"), F.asc("representante_origem")))


def government_flow_dense(df: DataFrame) -> DataFrame:
    """Zero-filled (representante_origem x tipo_ato) counts — the grid a categorical group-by
    emits, over the distinct labels and types that occur, whatever their number."""
    base = df.filter(F.col("representante_origem").isNotNull() & F.col("tipo_ato").isNotNull())
    counts = base.groupBy("representante_origem", "tipo_ato").agg(F.count(F.lit(1)).alias("n"))
    cells = grid(counts.select("representante_origem").distinct(), counts.select("tipo_ato").distinct())
    long = cells.join(counts, ["representante_origem", "tipo_ato"], "left")
    long = long.select("representante_origem", "tipo_ato", F.coalesce("n", F.lit(0)).cast("long").alias("quantidade"))
    return long.withColumn("fluxo", signed("quantidade"))


GRID_PARTS = 16


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` beside every row of the one-column ``right``: the result is all cells
    by definition.  The right rows are dealt to ``GRID_PARTS`` parts, each left row visits every
    part, so the cells are made by an ordinary join in as many tasks and nothing is gathered."""
    part = F.pmod(F.xxhash64(right.columns[0]), F.lit(GRID_PARTS)).cast("int")
    visits = left.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(GRID_PARTS - 1))))
    return visits.join(right.withColumn("__part", part), "__part").drop("__part")
