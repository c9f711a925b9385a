"""Session creation and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "lexikon",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with sane analytics defaults.

    On a cluster ``master`` stays ``None`` and the launcher decides; the
    defaults only fill in settings that are not already given.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # the live status store keeps job/stage/SQL-plan records even without a UI;
        # iterative training runs thousands of small jobs, so bound what it retains
        "spark.ui.retainedJobs": "200",
        "spark.ui.retainedStages": "200",
        "spark.ui.retainedTasks": "10000",
        "spark.sql.ui.retainedExecutions": "100",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    The cluster names it in ``spark.checkpoint.dir``; only in a local session
    where that is unset (tests, bench) a private scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="lexikon-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss), never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def stored(df, name: str):
    """``df`` written once as a compressed table below the shared checkpoint folder: a fraction of a
    checkpoint's bytes, which are rows as they lie in memory."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df) -> None:
    """Deletes the files of a table that ``stored`` wrote and that no plan reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_partitions(df):
    """Spread a scan over at least ``defaultParallelism`` tasks when it yields
    fewer partitions (few row groups) -- useful before CPU-heavy per-row text
    or vector work.  On a cluster reading many files it is a no-op."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def keep(df):
    """Cache an intermediate that several jobs reuse, on the executors' disks.

    Queries hand back lazy DataFrames, so their intermediates cannot be
    released inside the query; keeping them out of the heap leaves memory to
    execution (aggregations, model fitting) however many queries a session runs.
    """
    from pyspark import StorageLevel
    return df.persist(StorageLevel.DISK_ONLY)
