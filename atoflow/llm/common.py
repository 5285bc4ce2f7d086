"""Shared pieces of the training-data operators: written tables, connected components, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atoflow.session import ensure_checkpoint_dir

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def shared_table(df: DataFrame, label: str, compression: str = "zstd", bucket: str | None = None) -> DataFrame:
    """Write ``df`` under the session's checkpoint folder and read it back.

    The folder is the shared one that the cluster names, so the rows outlive any executor.  It is
    marked for deletion when the application ends; loops drop superseded tables with
    :func:`drop_table`.  With ``bucket`` the rows are laid out in as many buckets by that column as
    the session has shuffle partitions, and a join or grouping on it needs no exchange of them.
    """
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    writer = df.write.option("compression", compression)
    if bucket:
        table = name.replace("-", "_")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer.bucketBy(parts, bucket).option("path", path).saveAsTable(table)
        out = spark.table(table)
    else:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    fs, hadoop_path = _fs(spark, path)
    fs.deleteOnExit(hadoop_path)
    out._shared_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`shared_table` that nothing reads any more."""
    fs, path = _fs(df.sparkSession, df._shared_path)
    fs.delete(path, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters outside ``[\\x20\\x09-\\x0D]``."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: rows ``(node, root)``, root = smallest node.

    Alternating large-star and small-star rounds, each written to the shared folder, until the
    edges form stars.  The per-node minimum is combined map-side; the join back to the edges runs
    on a fresh exchange of both sides, so a node with very many edges is split by the skew join.
    No edges give no rows; loops and repeated edges are ignored.
    """
    spark = edges.sparkSession
    cur = shared_table(
        edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a < b").distinct(),
        "components")
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(_smallest(both, "a", "b"), "a").select(F.least("m", "a").alias("m"), "a", "b")
                 .filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b"))
        large = shared_table(large.distinct(), "components")
        small = large.join(_smallest(large, "b", "a"), "b")
        nxt = (small.select(F.col("m").alias("a"), "b")
               .union(small.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")).distinct())
        nxt = shared_table(nxt, "components")
        drop_table(cur)
        drop_table(large)
        cur = nxt
        # stars: every b has one edge, and no b is the centre of another edge
        twice = cur.groupBy("b").count().filter("count > 1").select(F.col("b").alias("x"))
        chained = cur.join(cur.select(F.col("a").alias("x")).distinct(), cur.b == F.col("x"), "left_semi").select("b")
        if twice.union(chained).isEmpty():
            return cur.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                cur.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _smallest(edges: DataFrame, key: str, value: str) -> DataFrame:
    # grouped by the key and its hash: the later join on the key alone gets its own exchange,
    # which the skew join can split
    return (edges.groupBy(key, F.xxhash64(key).alias("kh")).agg(F.min(value).alias("m")).select(key, "m"))
