"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atoflow.llm.common import fresh, shared_table

BUCKETS = 10_000
#: Expected number of labelled texts that the target model is fitted on.
MAX_TARGET = 20_000
#: A text is expected to belong to the target if its posterior is at least this.
POSTERIOR = 0.02
#: N-grams of the raw model that the target model starts from.
PRIOR = 1_000_000
SEED = 20_240_229
TOKEN = re.compile(r"\w+|[^\w\s]+")
PIECE = 1 << 18


class Hasher:
    """Bucket numbers of the lower-cased unigrams and bigrams of a text; words are hashed once a task."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.seen = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        seen = self.seen
        out = []
        for w in TOKEN.findall((text or "").lower()):
            h = seen.get(w)
            if h is None:
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                if len(seen) < 500_000:
                    seen[w] = h
            out.append(h)
        h = np.array(out, np.uint64)
        pairs = (h[:-1] * np.uint64(1_000_003) + h[1:] * np.uint64(31) + np.uint64(7)) if len(h) else h
        return np.concatenate([h, pairs]) % np.uint64(self.buckets)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket: log probability under the target model less that under the raw model.

    The raw model has one added to each bucket; the target model has ``PRIOR`` n-grams added in the
    raw model's proportions, so n-grams that a small target has not met are not taken for junk.
    """
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target / p + PRIOR) / (target.sum() + PRIOR))


def models(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
           buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> tuple[np.ndarray, float]:
    """``(log_ratio, share)``: raw counts over all texts, target counts over labelled good ones.

    The labelled texts are sampled by a hash of the id to an expected ``max_target``; share is the
    good part of all labelled rows.  Counts are added up in each task; ``buckets`` rows a task are
    shuffled and ``buckets`` rows come to the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(
        "id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    n_known, n_good = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n_good:
        return np.zeros(buckets), 1.0
    part = int(min(1.0, max_target / n_good) * (1 << 30))
    picked = known.filter((F.col("y") == 1) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part)).select("id", F.lit(1).alias("t"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), "id", "left").select(F.coalesce("t", F.lit(0)).alias("t"), "text")

    def count(batches):
        hasher, total = Hasher(buckets), np.zeros((2, buckets), np.int64)
        for b in batches:
            for t, text in zip(b.column("t").to_pylist(), b.column("text")):
                idx = hasher(text.as_py())
                for at in range(0, len(idx), PIECE):
                    c = np.bincount(idx[at:at + PIECE].astype(np.int64), minlength=buckets)
                    total[0] += c
                    if t:
                        total[1] += c
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])],
                                         names=["b", "raw", "target"])

    sums = rows.mapInArrow(count, "b int, raw long, target long").groupBy("b").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # at most `buckets` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums:
        raw[r.b], target[r.b] = r.raw, r.target
    return log_ratio(target, raw), n_good / n_known


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise, a function of the id and the seed alone; a null id is a value like any other."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("null"))), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weighted(docs: DataFrame, ratio: np.ndarray, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with the log importance weight of each whole text; null and empty texts weigh 0."""
    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    at = names.index(text_col)

    def run(batches):
        hasher = Hasher(len(ratio))
        for b in batches:
            w = [float(ratio[hasher(t.as_py()).astype(np.int64)].sum()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], names=[*names, out_col])

    return docs.mapInArrow(run, schema)


def order_key(x: Column) -> Column:
    """A long that orders as the double ``x`` does: its value in steps of 2^-20, cut at +-2^42."""
    return F.round(F.least(F.greatest(x, F.lit(-2.0 ** 42)), F.lit(2.0 ** 42)) * float(1 << 20)).cast("long")


def kth_largest(rows: DataFrame, key: str, k: int) -> int:
    """The k-th largest value of a long column: 16 bits a round, at most 65,536 counts to the driver."""
    prefix = None
    for shift in (48, 32, 16, 0):
        part = rows if prefix is None else rows.filter(F.shiftright(key, shift + 16) == prefix)
        for g, n in sorted(part.groupBy(F.shiftright(key, shift)).count().collect(), reverse=True):
            if k <= n:
                prefix = g
                break
            k -= n
    return prefix


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", seed: int = SEED) -> DataFrame:
    """One row per input row: id, log_weight, noisy (log_weight plus Gumbel noise), kept.

    The log weight of a text is the sum over its hashed unigrams and bigrams of the log ratio of
    the target model to the raw model.  ``share`` of the raw text being good, share * weight is the
    posterior of the target; k is the number of texts with a posterior of ``POSTERIOR`` or more.
    The k texts with the largest noisy weights are kept, which samples k texts without replacement
    in proportion to their weights; texts that tie with the k-th are kept too.  Without a good label
    all weights are 0 and every text is kept.
    """
    ratio, share = models(docs, labels, id_col, text_col, label_col)
    rows = weighted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ratio, "text", "log_weight")
    rows = rows.select("id", "log_weight", (F.col("log_weight") + gumbel(F.col("id"), seed)).alias("noisy"))
    rows = shared_table(rows.withColumn("key", order_key(F.col("noisy"))), "weights")
    low = cut(rows, share)
    return rows.select(F.col("id").alias(id_col), "log_weight", "noisy", (F.col("key") >= low).alias("kept"))


def cut(rows: DataFrame, share: float) -> int:
    """Order key of the last kept text; see :func:`resample`."""
    k = rows.filter(F.col("log_weight") >= float(np.log(POSTERIOR / share))).count()
    return kth_largest(rows, "key", k) if k else (1 << 63) - 1


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", seed: int = SEED) -> DataFrame:
    """``docs`` without the rows that :func:`resample` rejects, all columns kept.

    The weights are computed twice (once for the cut, once with the rows), so that no text is shuffled.
    """
    ratio, share = models(docs, labels, id_col, text_col, label_col)
    name = fresh(docs, "log_weight")
    noisy = lambda df: order_key(F.col(name) + gumbel(F.col(id_col), seed))
    all_rows = weighted(docs, ratio, text_col, name)
    slim = shared_table(weighted(docs.select(id_col, text_col), ratio, text_col, name).select(
        F.col(name).alias("log_weight"), noisy(None).alias("key")), "weights")
    low = cut(slim, share)
    return all_rows.filter(noisy(None) >= low).drop(name)
