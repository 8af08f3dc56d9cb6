"""Session helpers: a local builder for tests and benches, and checkpoint-dir handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "kindling",
                  event_log_dir: str | None = None) -> SparkSession:
    """Session used by tests and bench.py. Cluster jobs bring their own session.

    ``event_log_dir`` writes Spark's event log there (stage and task times without the UI)."""
    builder = SparkSession.builder
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KINDLING_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is only read here.
    Only a local-mode session without the setting (tests, benches) gets a fresh
    folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage on a cluster")
    local_dir = tempfile.mkdtemp(prefix="kindling-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    sc.setCheckpointDir(local_dir)
    return local_dir


def cut_lineage(df, how: str | None = None):
    """Cut the lineage of ``df`` into the shared checkpoint folder (never localCheckpoint).

    ``how="table"`` (default) writes the rows once as a parquet table under the
    folder and reads it back: the plan runs once, later scans get column pruning
    and predicate pushdown, and the files outlive any executor. ``how="rdd"`` uses
    Spark's reliable ``checkpoint()``.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    how = how or os.environ.get("KINDLING_CUT", "table")
    if how == "rdd":
        return df.checkpoint(eager=True)
    path = os.path.join(scratch_root(spark, root), uuid.uuid4().hex)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def broadcast_if_small(df, max_rows: int = 100_000):
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (it is counted), else ``df`` as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def scratch_root(spark: SparkSession, root: str | None = None) -> str:
    """Folder of this application's intermediate tables inside the checkpoint folder."""
    root = root or ensure_checkpoint_dir(spark)
    return os.path.join(root, "kindling-tables", spark.sparkContext.applicationId)


def drop_scratch_tables(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables (call once its results are written).

    Uses the Hadoop FileSystem of the checkpoint folder, so it works on shared storage.
    Returns whether anything was deleted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))
