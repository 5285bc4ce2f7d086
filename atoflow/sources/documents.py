"""Gazette documents: one markdown file per edition, read whole (``wholetext``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Stands in for a replacement character that the file itself holds (a code point reserved for internal use).
KEPT = "\ufdd0"


def read_documents(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, text) — one row per file; undecodable bytes are left out, CR and CRLF read as LF.

    An empty file gives no row; joined to its acts it reads like a missing one, as its label would be."""
    # the argument, not .option(): text() would reset the option to its own default (False)
    df = spark.read.text(path_glob, wholetext=True)
    valid = F.make_valid_utf8(F.replace(F.col("value"), F.lit("\ufffd"), F.lit(KEPT)))  # the rest is undecodable
    text = F.translate(valid, "\ufffd", "")
    text = F.regexp_replace(F.replace(text, F.lit(KEPT), F.lit("\ufffd")), "\r\n?", "\n")
    return df.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def with_document(acts: DataFrame, docs: DataFrame, path_col: str = "path") -> DataFrame:
    """Attach each act's document text; a missing document leaves ``text`` null (-> unknown)."""
    return acts.join(docs.select(path_col, "text"), path_col, "left")
