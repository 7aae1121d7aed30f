"""Scratch space and materialisation shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _setting(spark: SparkSession, name: str) -> str | None:
    return spark.conf.get(name, None) or spark.sparkContext.getConf().get(name, None)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a local session falls back
    to a folder under the system's temporary directory; a cluster session is refused, because a
    machine-local folder is neither visible to other executors nor safe against losing one.
    """
    context = spark.sparkContext
    root = _setting(spark, "spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="featmill-"))
    return context.getCheckpointDir()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system spelled out, as Spark resolves it.

    Archives are opened from Python, which does not know the cluster's default file system.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's own folder below :func:`scratch_root`; nothing is at it yet.

    The file system removes the folder when the driver's JVM ends, so no scratch table outlives its application.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/featmill-{spark.sparkContext.applicationId}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return qualified(spark, f"{folder.toString()}/{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Cuts lineage: what is read afterwards no longer depends on any executor, and every later use sees
    the same rows in the same numbering. Parquet keeps column pruning and gives later joins true sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
