"""Threshold-scaled shingle sketches of documents (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atoflow.llm.common import let, words

SHINGLE = 5
#: One in SCALE shingle hashes is below the threshold and retained.
SCALE = 8
#: Texts with fewer retained hashes than this keep their FLOOR smallest ones instead.
FLOOR = 8
ROWS_PER_BUCKET = 1024


def threshold(scale: int = SCALE) -> int:
    return (1 << 63) // scale


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Distinct non-negative 63-bit hashes of the word shingles (fewer words: of the whole sequence)."""
    def of(w):
        each = F.transform(F.sequence(F.lit(1), F.size(w) - shingle + 1), lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return (F.when(F.size(w) >= shingle, each).when(F.size(w) > 0, F.array(F.xxhash64(w)))
                .otherwise(F.array().cast("array<bigint>")))

    mask = F.lit((1 << 63) - 1)
    return F.array_distinct(F.transform(let(words(F.coalesce(text, F.lit(""))), of), lambda h: h.bitwiseAND(mask)))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE, floor: int = FLOOR) -> Column:
    """Struct ``(bound, kept)``: every distinct shingle hash up to ``bound`` (inclusive), ascending.

    ``bound`` is the fixed threshold, shared by all texts.  A text with fewer than ``floor`` hashes
    below it keeps its ``floor`` smallest hashes and their largest as bound (all, and the largest
    long, if it has no more than that).  Null and blank texts keep nothing.  Two sketches are
    merged by taking the union up to the smaller bound.
    """
    t = threshold(scale)

    def of(hashes):
        below = F.filter(hashes, lambda h: h < t)
        few = F.slice(F.sort_array(hashes), 1, floor)
        low = let(few, lambda s: F.struct(
            F.when(F.size(hashes) <= floor, F.lit((1 << 63) - 1)).otherwise(F.array_max(s)).alias("bound"),
            s.alias("kept")))
        return let(below, lambda b: F.when(
            F.size(b) >= floor, F.struct(F.lit(t - 1).alias("bound"), F.sort_array(b).alias("kept"))).otherwise(low))

    return let(shingle_hashes(text, shingle), of)


def merge(a: Column, b: Column) -> Column:
    """Sketch of the union of two shingle sets."""
    bound = F.least(a["bound"], b["bound"])
    return F.struct(bound.alias("bound"), F.sort_array(F.filter(
        F.array_union(a["kept"], b["kept"]), lambda h: h <= bound)).alias("kept"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, over the hashes both sketches are complete for.

    Two texts without shingles are alike (1.0); a text without shingles is contained in no other (0.0).
    Where :func:`comparable` is 0 for a text with shingles there is no estimate, and 0.0 stands for none.
    """
    bound = F.least(a["bound"], b["bound"])
    mine = F.filter(a["kept"], lambda h: h <= bound)
    return (F.when((F.size(a["kept"]) == 0) | (F.size(b["kept"]) == 0),
                   ((F.size(a["kept"]) == 0) & (F.size(b["kept"]) == 0)).cast("double"))
            .otherwise(F.coalesce(let(mine, lambda m: F.when(
                F.size(m) > 0, F.size(F.array_intersect(m, b["kept"])) / F.size(m))), F.lit(0.0))))


def comparable(a: Column, b: Column) -> Column:
    """Number of ``a``'s retained hashes up to the bound that both sketches are complete for: what containment rests on."""
    return F.size(F.filter(a["kept"], lambda h: h <= F.least(a["bound"], b["bound"])))


def fingerprint(sk: Column) -> Column:
    """The sketch as text: bound and retained hashes in hexadecimal."""
    hexed = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(hexed(sk["bound"]), F.lit(":"), F.array_join(F.transform(sk["kept"], hexed), ","))


def with_next(docs: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """``docs`` with a struct column ``next``: the ``carried`` columns of the next row, ascending ids.

    After the last row comes the first.  Rows with a null id come before all others, ordered by
    ``carried``; so do rows that share an id among themselves.  Ids are cut into equal ranges of
    about ``ROWS_PER_BUCKET`` rows (null ids by a hash of the row), so no window holds more than a
    range; the last row of a range takes the first of the next range that has rows, found by two
    more windows over the range numbers (per 1,024 ranges, then over those groups).
    """
    ids = docs.agg(F.min(id_col), F.max(id_col), F.count(id_col), F.count("*")).first()
    low, high, known, rows = ids
    if not rows:
        return docs.withColumn("next", F.struct(*carried))
    low, high = (low, high) if known else (0, 0)
    width = max(1, -(-(high - low + 1) * ROWS_PER_BUCKET // max(known, 1)))
    nulls = -(-(rows - known) // ROWS_PER_BUCKET) or 1
    tie = F.xxhash64(*carried)
    bucket = F.expr(f"(cast({id_col} as decimal(20)) - ({low})) div {width}").cast("long")
    if known < rows:
        bucket = F.when(F.col(id_col).isNull(), F.pmod(tie, F.lit(nulls)) - nulls).otherwise(bucket)
    rows_in = docs.select("*", bucket.alias("bucket"), tie.alias("tie"))
    w = Window.partitionBy("bucket").orderBy(F.col(id_col).asc_nulls_first(), "tie")
    seen = rows_in.select("*", F.lead(F.struct(*carried)).over(w).alias("lead"), F.row_number().over(w).alias("rn"))
    ranges = rows_in.groupBy("bucket").agg(F.lit(1).alias("one")).select("bucket", F.expr("bucket div 1024").alias("grp"))
    groups = ranges.groupBy("grp").agg(F.min("bucket").alias("first"))
    order = Window.orderBy("first")
    groups = groups.select("grp", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after"))
    following = ranges.select("bucket", "grp", F.lead("bucket").over(Window.partitionBy("grp").orderBy("bucket")).alias("lb"))
    following = following.join(groups, "grp").select("bucket", F.coalesce("lb", "after").alias("follows"))
    firsts = seen.filter("rn = 1").select(F.col("bucket").alias("follows"), F.struct(*carried).alias("start"))
    starts = following.join(firsts, "follows").select("bucket", "start")
    out = seen.join(starts, "bucket")
    return out.select(*docs.columns, F.coalesce("lead", "start").alias("next"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, text, sk)``: each whole text with its sketch; null texts count as empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", "text", sketch(F.col("text")).alias("sk"))
