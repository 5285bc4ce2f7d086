"""Toxicity by non-negative positive-unlabelled learning: numpy classifier, scored by Spark."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atoflow.llm.common import fresh

#: Expected numbers of confirmed and of unlabelled texts that the fit reads.
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
#: Word and word-prefix features of the classifier.
FEATURES = 2048
MIN_COUNT = 3
PREFIXES = (3, 4, 5, 6)
CUT = 0.7
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def text_features(text: str | None) -> set[str]:
    """Distinct lower-cased words of a whole text and their prefixes; empty for null."""
    out: set[str] = set()
    for w in set(WORD.findall((text or "").lower())):
        out.update(word_features(w))
    return out


@dataclass
class Model:
    """Linear classifier over the presence of the named features; ``score`` is a probability."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        weights, bias, seen = self.weights, self.bias, {}

        def score(text: str | None) -> float:
            hits: set[str] = set()
            for w in set(WORD.findall((text or "").lower())):
                found = seen.get(w)
                if found is None:
                    found = tuple(f for f in word_features(w) if f in weights)
                    if len(seen) < 500_000:
                        seen[w] = found
                hits.update(found)
            z = bias + sum(weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


class Rows:
    """Rows of present features: their numbers one row after the other, and how many each row has."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.n = flat.astype(np.int64), len(lengths)
        self.row = np.repeat(np.arange(self.n), lengths)

    def prob(self, w: np.ndarray) -> np.ndarray:
        z = w[-1] + np.bincount(self.row, weights=w[self.flat], minlength=self.n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def mean_gradient(self, of: np.ndarray, d: int) -> np.ndarray:
        return np.append(np.bincount(self.flat, weights=of[self.row], minlength=d), of.sum()) / self.n


def fit_nnpu(pos: Rows, unl: Rows, d: int, prior: float, steps: int = 400, rate: float = 0.05,
             decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier by the non-negative PU risk.

    Risk: prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]).  Where the
    corrected negative part falls below zero its gradient is reversed, as the method prescribes.
    """
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        sp, su = pos.prob(w), unl.prob(w)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        g_pos = -prior * pos.mean_gradient(1 - sp, d)
        g_neg = unl.mean_gradient(su, d) - prior * pos.mean_gradient(sp, d)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g[:d] += decay * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:d], float(w[d])


def held_out(id_col: str):
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, features: int = FEATURES) -> Model:
    """Fit on the rows that are not held out.

    Confirmed toxic rows and, without their labels, rows of all texts are sampled by a hash of the
    id to the expected numbers given.  Per feature of the confirmed rows its document counts in them
    and in all texts leave Spark, from which the ``features`` with the largest two-proportion score
    are chosen, and per sampled row the chosen features it has, for the gradient steps.  The class prior is the toxic share of the labelled
    rows that ``docs`` still has: an earlier stage may have dropped more of the one class than of the
    other.  Without a confirmed row every text scores 0; without a telling feature every text scores
    the prior, 0.5 at most.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(
        ~held_out("id") & F.col("y").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    n_known, n_pos = known.agg(F.count("*"), F.coalesce(F.sum(F.col("y")), F.lit(0))).first()
    if not n_pos:
        return Model({}, -50.0)
    prior = min(max(n_pos / n_known, 1e-4), 0.9)
    share = lambda most, of: F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, most / max(of, 1)) * (1 << 30))
    # at most about max_positive ids: small enough to send to every task
    picked = F.broadcast(known.filter((F.col("y") == 1) & share(max_positive, n_pos)).select("id", F.lit(1).alias("p")))
    n_docs = docs.count()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(~held_out("id"))
    texts = rows.select("text")
    rows = rows.join(picked, "id", "left").withColumn("u", share(max_unlabelled, n_docs * 2 / 3) | F.col("id").isNull())
    rows = rows.filter("p = 1 or u").select(F.coalesce("p", F.lit(0)).alias("p"), F.col("u").cast("int").alias("u"), "text")

    def confirmed(batches):
        totals, n = Counter(), 0
        for b in batches:
            n += b.num_rows
            for t in b.column("text").to_pylist():
                totals.update(text_features(t))
        totals[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["f", "p"])

    # features of at most about max_positive texts
    counts = rows.filter("p = 1").select("text").mapInArrow(confirmed, "f string, p long").groupBy("f").agg(F.sum("p").alias("p"))
    p_of = {r.f: r.p for r in counts.filter(f"p >= {MIN_COUNT} or f = ''").collect()}
    n = p_of.pop("", 0)
    if not n:
        return Model({}, -50.0)
    kept = sorted(p_of)
    known_place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(kept)})

    def everywhere(batches):
        at, seen, totals, m = known_place.value, {}, Counter(), 0
        for b in batches:
            m += b.num_rows
            for t in b.column("text"):
                hits: set[int] = set()
                for w in set(WORD.findall((t.as_py() or "").lower())):
                    found = seen.get(w)
                    if found is None:
                        found = tuple(at[f] for f in word_features(w) if f in at)
                        if len(seen) < 500_000:
                            seen[w] = found
                    hits.update(found)
                totals.update(hits)
        totals[-1] = m
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.int64())], names=["f", "u"])

    every = texts.mapInArrow(everywhere, "f int, u long").groupBy("f").agg(F.sum("u").alias("u")).toArrow()
    p, u = np.array([p_of[f] for f in kept], float), np.zeros(len(kept) + 1)
    u[every["f"].to_numpy()] = every["u"].to_numpy()
    u, m = u[:-1], u[-1]
    rate = (p + u) / (n + m)
    z = (p / n - u / m) / np.sqrt(np.maximum(rate * (1 - rate), 0) * (1 / n + 1 / m) + 1e-9)
    names = [kept[i] for i in np.argsort(-z, kind="stable")[:features].tolist() if z[i] > 0]
    if not names:
        return Model({}, min(0.0, float(np.log(prior / (1 - prior)))))
    place = {f: i for i, f in enumerate(names)}

    def find(batches):
        for b in batches:
            hits = [sorted(place[f] for f in text_features(t) if f in place) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), pa.array(hits, pa.list_(pa.int32()))], names=["p", "u", "hits"])

    found = rows.mapInArrow(find, "p int, u int, hits array<int>").toArrow()  # the bounded sample's features
    hits = found["hits"].combine_chunks()
    lengths, flat = np.diff(hits.offsets.to_numpy()), hits.flatten().to_numpy()
    sides = []
    for side in ("p", "u"):
        mine = found[side].to_numpy() == 1
        sides.append(Rows(flat[np.repeat(mine, lengths)], lengths[mine]))
    if not sides[1].n:
        return Model({}, -50.0)
    w, bias = fit_nnpu(*sides, len(names), prior)
    return Model({f: float(a) for f, a in zip(names, w)}, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score column, 0 to 1, for every row; null and empty texts score the bias alone.

    The model has at most ``FEATURES`` weights and travels with the function.  A column that
    already has the name of the score is replaced.
    """
    docs = docs.drop(out_col)
    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    at = names.index(text_col)

    def run(batches):
        of = model.scorer()
        for b in batches:
            s = pa.array([of(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*names, out_col])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``CUT`` or more, all columns kept."""
    model, col = train(docs, labels, id_col, text_col), fresh(docs, "toxicity_score")
    return score(docs, model, text_col, col).filter(F.col(col) < CUT).drop(col)
