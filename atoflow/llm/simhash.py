"""SimHash fingerprints and exact near-duplicate components by tiled comparison."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atoflow.llm.common import components, fresh, shared_table

SEED = 42
#: Expected fingerprints in a tile.
TILE = 1024
#: A fingerprint's population counts are taken per 16-bit word, so a tile has four of them.
PARTS, PART_BITS = 4, 16
BASE = PART_BITS + 1


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash (unsigned) of the ``shingle``-word shingles, repeats included.

    A-Z are lower-cased, words are runs outside ``[\\x20\\x09-\\x0D]``, a text of fewer words is one
    shingle, a text without words (or null) has fingerprint 0.  A bit is set if it is set in more
    than half the XXH64 hashes (UTF-8, seed 42).
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return h(b" ".join(w), SEED)
    total, step = np.zeros(64, np.int64), 1 << 16
    n = len(w) - shingle + 1
    for at in range(0, n, step):  # a very long text is counted piece by piece
        part = np.fromiter((h(b" ".join(w[i:i + shingle]), SEED) for i in range(at, min(n, at + step))), np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """Rows ``(id, fp)``: fp is the fingerprint as a signed long."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], names=["id", "fp"])

    return src.mapInArrow(run, f"id {id_type}, fp long")


def _part_counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, PART_BITS * i).bitwiseAND(F.lit((1 << PART_BITS) - 1)))
            for i in range(PARTS)]


def tiles(fps: DataFrame) -> DataFrame:
    """Tiles of distinct fingerprints ``(tile, c0..c3, fps)``: equal population counts per 16-bit word.

    Fingerprints with the same four counts are dealt by hash to as many tiles as keep ``TILE`` of
    them in each.  The table of counts has at most 17^4 = 83,521 rows, so it may be broadcast.
    """
    c = [f"c{i}" for i in range(PARTS)]
    rows = fps.select("fp", *(x.alias(n) for n, x in zip(c, _part_counts(F.col("fp")))))
    slots = rows.groupBy(*c).agg(F.ceil(F.count("*") / TILE).alias("slots"))
    dealt = rows.join(F.broadcast(slots), c).withColumn("slot", F.pmod(F.xxhash64("fp"), F.col("slots")))
    return dealt.groupBy(*c, "slot").agg(F.collect_list("fp").alias("fps"))


def neighbour_offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius; of each pair of opposites only one."""
    zero = (0,) * PARTS
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=PARTS)
            if sum(map(abs, d)) <= radius and d >= zero]


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius`` bits between two tiles."""
    close = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    if same:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = top((0, a)), top((0 if same else 1, b))
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints: all pairs of tiles are compared exactly by
    exclusive-or and bit counts, except those whose population counts differ beyond the radius.

    The differences of the four word counts sum to at most the bit distance, so a skipped pair of
    tiles has no link.  Each pair of tiles gives a spanning forest of its links: components stay
    the same, and a dense group gives fewer links than fingerprints rather than all its pairs.
    """
    t = shared_table(tiles(fps), "tiles")
    c = [f"c{i}" for i in range(PARTS)]
    offsets = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(c, d))) for d in neighbour_offsets(radius)))
    code = lambda cols: sum((x * BASE ** i for i, x in enumerate(cols)), F.lit(0))
    left = t.select("*", F.explode(offsets).alias("d"))
    left = left.select(F.col("slot").alias("ls"), F.col("fps").alias("lf"),
                       *((F.col(n) + F.col(f"d.{n}")).alias(f"n_{n}") for n in c),
                       sum((F.abs(F.col(f"d.{n}")) for n in c), F.lit(0)).alias("off"))
    left = left.filter(" and ".join(f"n_{n} between 0 and {PART_BITS}" for n in c))
    left = left.select(code([F.col(f"n_{n}") for n in c]).alias("k"), "ls", "lf", (F.col("off") == 0).alias("own"))
    right = t.select(code([F.col(n) for n in c]).alias("k"), F.col("slot").alias("rs"), F.col("fps").alias("rf"))
    pairs = left.join(right, "k").filter("not own or ls <= rs").select(
        "lf", "rf", (F.col("own") & (F.col("ls") == F.col("rs"))).alias("same"))

    def run(batches):
        for b in batches:
            u, v = [], []
            same = b.column("same").to_pylist()
            sides = []
            for side in ("lf", "rf"):
                x = b.column(side)
                sides.append((x.offsets.to_numpy(), x.values.to_numpy().view(np.uint64)))
            (lo, lv), (ro, rv) = sides
            for k in range(b.num_rows):
                a, z = lv[lo[k]:lo[k + 1]], rv[ro[k]:ro[k + 1]]
                for i, j in tile_links(a, z, same[k], radius):
                    u.append(a[i])
                    v.append(z[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               radius: int = 2) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id, root (smallest fp of the component).

    Fingerprints within ``radius`` bits are linked; component_id is the smallest id reachable
    (null only if all its rows have null ids).  Equal fingerprints are one node, whatever number
    of rows share it; a text without words has fingerprint 0 and is linked like any other.  Other
    columns are not read.  An empty table gives no rows.
    """
    rows = shared_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = shared_table(rows.groupBy("fp").agg(F.min("id").alias("low")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = shared_table(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fingerprint-classes")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id, all columns kept.

    Rows repeated under one id are reduced to one; a component of null ids keeps one row.
    """
    found = near_dedup(docs, id_col, text_col, shingle, radius)
    key = fresh(docs, "row_key")
    locator = lambda i, fp: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("null")), fp.cast("string"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "fp")).alias("m"))
    keep = first.select(locator(F.col("m.id"), F.col("m.fp")).alias(key))
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())])
    names = docs.columns

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(names.index(text_col))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*names, key])

    keyed = docs.mapInArrow(run, schema).withColumn(key, locator(F.col(id_col), F.col(key)))
    return keyed.join(keep, key, "left_semi").dropDuplicates([key]).drop(key)
