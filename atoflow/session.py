"""Session helpers: a local session for tests/bench and the checkpoint directory rule."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "atoflow") -> SparkSession:
    """Reuse the active session untouched (a cluster's settings win), or build a local one.

    The local defaults size shuffles to the cores; on a cluster size them to the data instead,
    e.g. ``spark.sql.shuffle.partitions`` so a partition holds ~128-256 MB after AQE coalescing
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), with AQE skew-join splitting enabled.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app_name)
        .master(master or f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only where the session has none.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting is always used as is.
    Only in local mode (tests, bench) is a scratch folder created when it is unset; on a cluster an
    unset folder is an error rather than a silent machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (executors must reach it); "
                               "a machine-local scratch folder is used only in local mode")
        configured = tempfile.mkdtemp(prefix="atoflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_folder(spark, label: str) -> str:
    """A new path under the checkpoint directory, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/atoflow-{label}-{uuid.uuid4().hex}"
    fs, where = _hadoop(spark, path)
    # the file system forgets paths that do not exist yet, so the folder is made first
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def materialize(df, label: str = "table"):
    """Write ``df`` as parquet under the checkpoint directory and read it back.

    This cuts lineage *and* the retained logical plan (``Dataset.checkpoint`` keeps the origin
    plan, which doubles per round when an iteration uses its previous result twice).  The files
    live in the shared checkpoint folder, so a lost executor cannot lose them; they are deleted by
    ``discard`` or when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.mode("overwrite").parquet(path)  # the folder exists, empty
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    return out


def discard(df) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    fs, path = _hadoop(df.sparkSession, df._materialized)
    fs.delete(path, True)


def _hadoop(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
