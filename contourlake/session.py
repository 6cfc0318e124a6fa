"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "contourlake", cpus: str | int = "*", partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks, with a cluster's four attempts per task; on a cluster pass your own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus},4]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # calls are rows with long arrays: keep Arrow batches small in rows and in bytes
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        # little data, much work per byte: let small post-shuffle partitions stay apart
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # call-site capture costs a round trip per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` where the cluster names one.

    Only on a local master, where driver and executors share one machine, an unset folder is replaced by a temporary
    one, which is removed when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="contourlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table under the shared folder, kept until ``drop_scratch``."""
    return f"{shared_dir(spark)}/contourlake/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of the shared folder; call it when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/contourlake")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
