"""Exact dedup by content-defined chunk recipes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atoflow.llm.common import SPACES, fresh, shared_table

#: A chunk ends after a sentence mark whose preceding character has a code divisible by three (one
#: mark in three or so, chosen by the content alone), at 64 to 4,096 characters.
BEFORE_CUT = "".join(chr(c) for c in range(0x21, 0x100) if c % 3 == 0 and chr(c).isalnum())
CHUNK = rf"(?s).{{64,4094}}?[{BEFORE_CUT}][.!?]|.{{1,4096}}"
MAX_ROUNDS = 8


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def chunk_list(norm: Column) -> Column:
    """Content-defined chunks of a normalised text, in order; their concatenation is the text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def _ident(chunk: Column, salt: int, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    return [F.xxhash64(F.lit(2 * salt + k), chunk).bitwiseAND(mask) for k in (0, 1)]


def recipes(docs: DataFrame, id_col: str, text_col: str, salt: int, bits: int) -> DataFrame:
    """One slim row per document: uid, id, n (code points), sha (of the normalised text), recipe."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), normalised(F.col("text")).alias("norm"))
    return base.select(
        F.monotonically_increasing_id().alias("uid"), "id", "n", F.sha2("norm", 256).alias("sha"),
        F.transform(chunk_list(F.col("norm")),
                    lambda c: F.struct(*(x.alias(a) for a, x in zip("xy", _ident(c, salt, bits))))).alias("recipe"))


def collisions(docs: DataFrame, text_col: str, salt: int, bits: int) -> DataFrame:
    """Identifiers that stand for more than one chunk text.  Each chunk text moves once per task."""
    chunks = docs.select(normalised(F.col(text_col)).alias("norm")).select(
        F.explode(chunk_list(F.col("norm"))).alias("chunk"))
    x, y = _ident(F.col("chunk"), salt, bits)
    distinct = chunks.select(x.alias("x"), y.alias("y"), "chunk").distinct()
    return distinct.groupBy("x", "y").count().filter("count > 1")


def verified_recipes(docs: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """Recipes whose identifiers are proved to stand for one chunk text each.

    An identifier is a pair of salted 64-bit hashes.  All distinct chunk texts are compared per
    identifier; if two differ, another salt (at full width) is taken and the proof repeated.
    """
    for salt in range(1, MAX_ROUNDS + 1):
        width = bits if salt == 1 else 64
        if collisions(docs, text_col, salt, width).isEmpty():
            return shared_table(recipes(docs, id_col, text_col, salt, width), "recipes")
    raise RuntimeError("chunk identifiers collided for every salt")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: id, n_chars, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms (white space deleted, null as empty) have equal
    recipes: the ordered lists of verified chunk identifiers.  Of equal texts the row with the
    most code points stays, then the smallest id (null ids first); of rows equal in both, one.
    Columns beside the two named
    ones are not read, so clashing names do no harm.  An empty table gives no rows; all empty texts
    form one group.

    The recipes are a few per cent of the text; grouping and joining move only them.  The group
    aggregate is combined map-side, and its join back runs on its own exchange, so that the skew
    join can split a recipe that a third of the rows share.
    """
    rows = verified_recipes(docs, id_col, text_col, bits)
    best = (rows.groupBy(F.xxhash64("recipe").alias("h"), "recipe")
            .agg(F.min(F.struct((-F.col("n")).alias("n"), "id", "uid")).alias("best"), F.count("*").alias("group_size"))
            .select("recipe", F.col("best.id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size"))
    return rows.join(best, "recipe").select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The keeper is found again by its id, length and text hash, so no text is moved but in this one
    join.  Rows repeated with the same id, length and text are reduced to any one of them.
    """
    key = fresh(docs, "row_key")
    locator = lambda i, n, sha: F.concat_ws("|", sha, n.cast("string"), F.coalesce(i.cast("string"), F.lit("null")))
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    keep = kept.select(locator(F.col(id_col), F.col("n_chars"), F.col("text_sha256")).alias(key))
    keyed = docs.withColumn(key, locator(F.col(id_col), F.coalesce(F.length(text_col), F.lit(0)),
                                         F.sha2(normalised(F.col(text_col)), 256)))
    return keyed.join(keep, key, "left_semi").dropDuplicates([key]).drop(key)
