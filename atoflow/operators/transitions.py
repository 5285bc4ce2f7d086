"""Event sequences, transition counts, probability matrix, flow edges and node degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .flows import grid
from .sequences import day_and_id_block, instant_and_id_block, neighbours


def return_events(ret_c: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Unpivot each return row into up to two events: the dismissal ('E', ord 0) and the
    appointment (its ``estado_N``, ord 1).  Columns: pessoa, data, evento, mov_id, ord (+extra).

    One pass over the input (``explode`` of a two-element array), not a union of two scans.
    """
    extra = extra or []
    pair = F.array(
        F.struct(F.col("data_exoneracao").alias("data"), F.lit(K.EVENTO_EXONERACAO).alias("evento"),
                 F.lit(0).alias("ord")),
        F.struct(F.col("data_nomeacao").alias("data"), F.col("estado_N").alias("evento"), F.lit(1).alias("ord")))
    ev = ret_c.select("pessoa", "mov_id", *extra, F.explode(pair).alias("e"))
    ev = ev.select("pessoa", F.col("e.data").alias("data"), F.col("e.evento").alias("evento"), "mov_id",
                   F.col("e.ord").alias("ord"), *extra)
    return ev.filter(F.col("data").isNotNull())


def next_event(ev: DataFrame, key: list[str], order: list[str], bucket: Column, coarser) -> DataFrame:
    """``prox_evento`` = the person's next event (null on the last); null persons are dropped
    (they form no group).  Hot persons are split over (key, bucket) and carried through ``coarser`` buckets."""
    ev = ev.filter(F.col(key[-1]).isNotNull())
    return neighbours(ev, key, order, bucket, coarser, leads={"prox_evento": "evento"})


def event_sequence(ret_c: DataFrame) -> DataFrame:
    """(pessoa, data, evento, prox_evento, mov_id, ord) from the returns table."""
    ev = return_events(ret_c)
    bucket, coarser = day_and_id_block(F.unix_date(F.col("data")), "mov_id")
    return next_event(ev, ["pessoa"], ["data", "mov_id", "ord"], bucket, coarser)


def user_event_sequence(events: DataFrame) -> DataFrame:
    """(pessoa, data, evento, prox_evento) from a raw (user_id, ts, event_type, event_id) log.
    A very active user is cut by instant and id block, so it is spread over many tasks."""
    ev = events.select(F.col("user_id").alias("pessoa"), F.col("ts").alias("data"),
                       F.col("event_type").alias("evento"), "event_id")
    ev = ev.filter(F.col("data").isNotNull())
    bucket, coarser = instant_and_id_block("data", "event_id")
    return next_event(ev, ["pessoa"], ["data", "event_id"], bucket, coarser)


def transitions(seq: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(evento, prox_evento, n) edge counts (partially aggregated map-side)."""
    by = by or []
    return (seq.filter(F.col("prox_evento").isNotNull() & F.col("evento").isNotNull())
               .groupBy(*by, "evento", "prox_evento").agg(F.count(F.lit(1)).alias("n")))


def top_transitions(trans: DataFrame, k: int = K.TOP_N_TRANSICOES) -> DataFrame:
    """The k heaviest edges (ties -> source, target) with their rank 1..k."""
    order = [F.desc("n"), F.asc("evento"), F.asc("prox_evento")]
    top = trans.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def transitions_by_year(ret_c: DataFrame, k: int = K.TOP_N_TRANSICOES) -> DataFrame:
    """Top-k transitions per appointment year; each year's sequences are built only from that
    year's rows.  (ano, evento, prox_evento, n, rank, source, target).

    The node ordinals run over the sorted labels of all years' top edges (k rows a year, one row here)."""
    ev = return_events(ret_c.filter(F.col("ano").isNotNull()), extra=["ano"])
    bucket, coarser = day_and_id_block(F.unix_date(F.col("data")), "mov_id")
    seq = next_event(ev, ["ano", "pessoa"], ["data", "mov_id", "ord"], bucket, coarser)
    trans = transitions(seq, by=["ano"])
    w = Window.partitionBy("ano").orderBy(F.desc("n"), F.asc("evento"), F.asc("prox_evento"))
    top = trans.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return _with_ordinals(top, ["ano", "evento", "prox_evento", "n", "rank"])


def states(trans: DataFrame) -> DataFrame:
    """Distinct states seen as source or target."""
    return trans.select(F.col("evento").alias("s")).union(trans.select(F.col("prox_evento").alias("s"))).distinct()


def transition_matrix(trans: DataFrame) -> DataFrame:
    """Square matrix over all states in long form: (evento, prox_evento, n, p, p_txt).

    The result has |S| x |S| cells by definition; they are made by :func:`flows.grid`, and the
    observed counts are joined in; rows summing to 0 get p = 0.
    """
    s = states(trans)
    cells = grid(s.withColumnRenamed("s", "evento"), s.withColumnRenamed("s", "prox_evento"))
    counts = trans.select("evento", "prox_evento", F.col("n").cast("long").alias("n"))
    long = cells.join(counts, ["evento", "prox_evento"], "left").fillna(0, subset=["n"])
    total = F.sum("n").over(Window.partitionBy("evento"))
    long = long.withColumn("p", F.col("n") / F.when(total == 0, F.lit(1)).otherwise(total))
    # format_number rounds the exact binary value half-even, like Python's "{:.2f}"
    return long.withColumn("p_txt", F.format_number(F.col("p"), 2))


def sankey_edges(trans: DataFrame, k: int = K.TOP_N_TRANSICOES) -> DataFrame:
    """Top-k edges with node ordinals over the sorted labels of those edges:
    (evento, prox_evento, n, source, target).

    The k edges are gathered into one array (bounded by k) so the top-k plan is referenced once;
    labels and ordinals are array functions on that single row.
    """
    top = trans.orderBy(F.desc("n"), F.asc("evento"), F.asc("prox_evento")).limit(k)
    return _with_ordinals(top, ["evento", "prox_evento", "n"])


def _with_ordinals(edges: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of a bounded list of edges, and the ordinals of their ends over its sorted labels."""
    one = edges.agg(F.collect_list(F.struct(*columns)).alias("e"))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("e", lambda x: x["evento"]),
                                                    F.transform("e", lambda x: x["prox_evento"]))))
    one = one.select(F.explode("e").alias("x"), labels.alias("labels"))
    return one.select(
        *(F.col(f"x.{c}").alias(c) for c in columns),
        (F.array_position("labels", F.col("x.evento")) - 1).cast("int").alias("source"),
        (F.array_position("labels", F.col("x.prox_evento")) - 1).cast("int").alias("target"))


def node_degree(trans: DataFrame, k: int = K.TOP_N_TRANSICOES) -> DataFrame:
    """Degree (in + out; a self-loop counts twice) of each node of the top-k edge graph, and the
    drawn node size 8 + 4*degree: (no, grau, tamanho)."""
    top = trans.orderBy(F.desc("n"), F.asc("evento"), F.asc("prox_evento")).limit(k)
    ends = top.select(F.explode(F.array("evento", "prox_evento")).alias("no"))
    deg = ends.groupBy("no").agg(F.count(F.lit(1)).alias("grau"))
    return deg.withColumn("tamanho", F.lit(8) + F.lit(4) * F.col("grau"))
