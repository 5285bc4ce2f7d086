"""Variable-capacity best-fit packing of texts into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atoflow.llm.common import SPACE_CLASS, shared_table

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together by one task.
SHARD = 50_000
#: Cost of a sequence of n tokens: n, attention's part growing with n, and a part each sequence has.
QUADRATIC, FIXED = 1 / 32_768, 16.0


def cost(capacity: float) -> float:
    return capacity + capacity * capacity * QUADRATIC + FIXED


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS[1:]}+"))


def best_fit(lengths: np.ndarray, capacities=CAPACITIES, price=cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack pieces, longest first: bin number and offset of each, and the capacity of each bin.

    A piece goes to the open bin with the least room that holds it.  If none does, the size is
    opened that costs least per token expected in it: the piece and whatever of the pieces still
    to come fits beside it.  At the end each bin shrinks to the least size that holds its contents.
    Ties go to the bin opened last; pieces of one length keep their order.
    """
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some open bin has room r
    used: list[int] = []
    size: list[int] = []
    left = int(lengths.sum())
    for i in order.tolist():
        n = int(lengths[i])
        if n > caps[-1]:
            raise ValueError("a piece is longer than the largest capacity")
        left -= n
        fits = rooms >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room = min((c for c in caps if c >= n), key=lambda c: (price(c) / min(c, max(n + left, 1)), c))
            b = len(used)
            used.append(0)
            size.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        by_room.setdefault(room - n, []).append(b)
        rooms |= 1 << (room - n)
    final = np.array([min(c for c in caps if c >= u) for u in used], np.int64)
    return bins, offsets, final


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None,
         capacities=CAPACITIES, shard: int = SHARD) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin, bin_offset, capacity, bin_tokens.

    ``length`` gives the tokens of a row (default: its words; null counts as 0).  A row longer than
    the largest capacity is cut into consecutive pieces of that capacity and a rest, so nothing is
    dropped; an empty row is one piece of no tokens.  Pieces are dealt by a hash of their row
    number, not of the id, to shards of about ``shard`` pieces, and each shard is packed by one
    task; a hot source or repeated id cannot fill a shard.  Other columns are not read; repeated
    rows are packed each; an empty table gives no rows.  ``bin`` is shard * 2^32 + number.
    """
    biggest = max(capacities)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(
        word_count(F.col(text_col)) if length is None else length, F.lit(0)).cast("long").alias("total"))
    slim = shared_table(slim.select(F.monotonically_increasing_id().alias("uid"), "id", "total"), "lengths")
    pieces = slim.select("uid", "id", "total", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.expr(f"(total - 1) div {biggest}"), F.lit(0).cast("long")))).alias("piece"))
    pieces = pieces.select("uid", "id", "piece", (F.col("piece") * biggest).alias("start"),
                           F.least(F.col("total") - F.col("piece") * biggest, F.lit(biggest)).alias("n_tokens"))
    n = pieces.count()
    shards = max(1, -(-n // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("uid", "piece"), F.lit(shards)))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "piece"], kind="stable")
        lengths = pdf["n_tokens"].to_numpy(np.int64)
        b, at, size = best_fit(lengths, capacities)
        full = np.bincount(b, weights=lengths, minlength=len(size)).astype(np.int64)
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "n_tokens": lengths,
                             "bin": (pdf["shard"].to_numpy(np.int64) << 32) + b, "bin_offset": at,
                             "capacity": size[b], "bin_tokens": full[b]})

    out = dealt.groupBy("shard").applyInPandas(
        run, f"id {id_type}, piece long, start long, n_tokens long, bin long, bin_offset long, capacity long, bin_tokens long")
    return out.withColumnRenamed("id", id_col)
