"""Steady state of the transition chain, computed distributed from its sparse edges.

States without an outgoing edge are made absorbing; the lazy chain Q = (I + P) / 2 has the same
stationary vectors as P and is aperiodic, so the distribution reached from the uniform start
converges.  For a reducible chain (e.g. an absorbing end state) that limit is the well-defined
answer; it can be approached very slowly, so the matrix is squared: after k rounds Q^(2^k).  A
squaring is a join of the edges with themselves on the middle state plus a group-by, the same for
any number of states.  Every ``per_round`` squarings the result is written to the shared folder,
which cuts lineage; the round before is deleted.  Convergence is geometric, so a change below
1e-9 between Q^(2^k) and Q^(2^(k+5)) leaves an error far below the 6 digits kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize


def lazy_chain(trans: DataFrame) -> DataFrame:
    """(i, j, q) for Q = (I + P) / 2 from edges (evento, prox_evento, n); no row for q = 0."""
    edges = trans.select(F.col("evento").alias("i"), F.col("prox_evento").alias("j"), F.col("n").cast("double").alias("n"))
    ends = edges.select(F.col("j").alias("s")).union(edges.select(F.col("i").alias("s"))).distinct()
    stay = ends.join(edges.groupBy("i").agg(F.sum("n").alias("out")), F.col("s") == F.col("i"), "left")
    # an absorbing state stays with certainty, any other with one half besides its own loop
    half = stay.select(F.col("s").alias("i"), F.col("s").alias("j"),
                       F.when(F.coalesce("out", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("q"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("i"))
    moves = edges.filter("n > 0").select("i", "j", (0.5 * share).alias("q"))
    return moves.union(half).groupBy("i", "j").agg(F.sum("q").alias("q"))


def _square(m: DataFrame) -> DataFrame:
    left = m.select(F.col("i"), F.col("j").alias("k"), F.col("q").alias("a"))
    right = m.select(F.col("i").alias("k"), F.col("j"), F.col("q").alias("b"))
    # products below 1e-300 are no part of any kept digit
    return (left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("q"))
                .filter(F.col("q") > 1e-300))


def _renormalise(m: DataFrame) -> DataFrame:
    """Rows back to sum 1: rounding in the row sums doubles with every squaring, so without this
    the powers drift away from the limit (done once per written round)."""
    return m.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy("i")))


def _max_change(a: DataFrame, b: DataFrame) -> float:
    both = a.select("i", "j", "q").union(b.select("i", "j", (-F.col("q")).alias("q")))
    d = both.groupBy("i", "j").agg(F.abs(F.sum("q")).alias("d")).agg(F.max("d")).first()[0]
    return d or 0.0


def steady_state(trans: DataFrame, rounds: int = 60, tol: float = 1e-9, digits: int = 6,
                 per_round: int = 5) -> DataFrame:
    """(evento, prob): limit distribution from the uniform start, rounded to ``digits``.

    Takes the edges (evento, prox_evento, n); no edges give no rows.  Raises if 2^``rounds`` steps
    do not converge.  Actions: per round one written table and one scalar convergence check.
    """
    m = materialize(lazy_chain(trans), "markov")
    for _ in range(0, rounds, per_round):
        nxt = m
        for _ in range(per_round):
            nxt = _square(nxt)
        nxt = materialize(_renormalise(nxt), "markov")
        change = _max_change(nxt, m)
        discard(m)
        m = nxt
        if change <= tol:
            break
    else:
        raise RuntimeError(f"no steady state: the last {per_round} squarings still change entries by {change:g}")
    n_states = m.select("i").distinct().count()
    x = m.groupBy(F.col("j").alias("s")).agg((F.sum("q") / F.lit(float(max(n_states, 1)))).alias("x"))
    # a state that the limit never visits keeps its row
    x = x.union(m.select(F.col("i").alias("s"), F.lit(0.0).alias("x"))).groupBy("s").agg(F.sum("x").alias("x"))
    total = F.coalesce(x.agg(F.sum("x").alias("t")).select("t").scalar(), F.lit(1.0))
    return x.select(F.col("s").alias("evento"), F.round(F.col("x") / total, digits).alias("prob"))
