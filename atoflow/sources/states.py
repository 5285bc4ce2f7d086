"""Per-state input directories: ``<root>/<UF>/movimentacoes_pessoas.parquet`` and
``<root>/<UF>/retornos_apos_exoneracao.csv``.

* S3/S5  discovery: a state counts only when both files exist; none -> FileNotFoundError.  The
  listing goes through the Hadoop FileSystem of the session, so any cluster store works.
* S2/S4  one parquet scan over all qualifying states; ``estado`` = upper-cased parent folder,
  taken from the hidden ``_metadata.file_path`` column (no extra pass).
* S1     CSV scan with the known column names (others ignored, absent ones added as null); the
  pandas missing-value sentinels read as null.
* S7     ``reload`` re-lists and rebuilds the DataFrames (files may have changed).
* S8     ``write_partitioned`` writes a cleaned table partitioned by ``estado``, so the state
  filter of a later slice prunes whole directories.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def complete_states(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """Sorted (state, directory) pairs whose folder holds both input files."""
    fs, base = _fs(spark, root)
    if not fs.exists(base):
        raise FileNotFoundError(f"no analysis folder at {root}")
    out = []
    for st in fs.listStatus(base):
        if not st.isDirectory():
            continue
        d = st.getPath()
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if fs.exists(jvm_path(d, K.ARQUIVO_RETORNOS)) and fs.exists(jvm_path(d, K.ARQUIVO_MOVIMENTACOES)):
            out.append((d.getName().upper(), d.toString()))
    out.sort()
    if not out:
        raise FileNotFoundError(f"no per-state analysis found in {root}")
    return out


def state_from_path(path_col: Column | None = None) -> Column:
    """Upper-cased name of the folder that holds the input, be it one file or a folder of part files.

    ``_metadata.file_path`` is percent-encoded, so the name is decoded; a plus sign stands for itself.
    """
    p = path_col if path_col is not None else F.col("_metadata.file_path")
    names = "|".join(re.escape(n) for n in (K.ARQUIVO_MOVIMENTACOES, K.ARQUIVO_RETORNOS))
    folder = F.regexp_extract(p, rf"/([^/]+)/(?:{names})(?:/[^/]+)?$", 1)
    return F.upper(F.coalesce(F.try_url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))), folder))


def read_movements(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """One scan over every state's parquet file; schemas are merged (files may differ), known
    columns are projected (the scan reads only those); a missing one is an error, as in a read
    that names its columns."""
    paths = [f"{d}/{K.ARQUIVO_MOVIMENTACOES}" for d in dirs]
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    missing = [c for c in K.COLUNAS_MOVIMENTACAO if c not in df.columns]
    if missing:
        raise ValueError(f"movements lack the columns {missing}")
    return df.select(*K.COLUNAS_MOVIMENTACAO, state_from_path().alias("estado"))


def _null_sentinels(c: str) -> Column:
    return F.when(F.col(c).isin(*K.CSV_NULOS), F.lit(None).cast("string")).otherwise(F.col(c))


FLAGS = ("mudou_cargo_desde_exoneracao", "mudou_orgao_desde_exoneracao")


def _flags(df: DataFrame) -> DataFrame:
    """Change flags of one file as 'sim' / 'nao' where the whole column is boolean (True/False) or
    numeric (not 0); other columns stay as written.  One aggregate over the file, like the type
    inference of a CSV reader."""
    is_bool = lambda c: F.col(c).isin("True", "TRUE", "true", "False", "FALSE", "false")
    number = lambda c: F.col(c).try_cast("double")
    kinds = df.agg(*(F.struct(F.bool_and(is_bool(c)).alias("b"), F.bool_and(number(c).isNotNull() | F.col(c).isNull()).alias("n"))
                     .alias(c) for c in FLAGS)).first()
    for c in FLAGS:
        true = F.lower(c) == "true" if kinds[c].b else number(c) != 0 if kinds[c].n else None
        if true is not None:
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.when(true, F.lit("sim")).otherwise(F.lit("nao"))))
    return df


def read_returns(spark: SparkSession, dirs: list[str], multiline: bool = True) -> DataFrame:
    """All state CSVs; each file is read with its own header (files may differ in columns) and
    the known columns are unioned by name.

    ``multiline=True`` parses quoted fields containing line breaks exactly as the pandas reader
    does, but a multi-line CSV cannot be split, so each file is one task.  For very large inputs
    read once and keep the cleaned table as partitioned parquet (``write_partitioned``), or pass
    ``multiline=False`` when the files are known to hold no embedded line breaks."""
    frames = []
    for d in dirs:
        raw = (spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
               .csv(f"{d}/{K.ARQUIVO_RETORNOS}"))
        cols = []
        for c in K.COLUNAS_RETORNO:
            cols.append(_null_sentinels(c).alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c))
        frames.append(_flags(raw.select(*cols, state_from_path().alias("estado"))))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("dias_desde_exoneracao", F.col("dias_desde_exoneracao").try_cast("double"))


def read_state_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(returns, movements) of every complete state under ``root``."""
    dirs = [d for _, d in complete_states(spark, root)]
    return read_returns(spark, dirs), read_movements(spark, dirs)


def reload(spark: SparkSession, root: str):
    """Re-read and re-clean both tables: returns (ret_c, mov_c)."""
    from ..operators.cleanse import clean_movements, clean_returns

    spark.catalog.refreshByPath(root)
    ret, mov = read_state_tables(spark, root)
    return clean_returns(ret), clean_movements(mov)


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink (action): parquet partitioned by ``estado``."""
    df.write.mode(mode).partitionBy("estado").parquet(path)
