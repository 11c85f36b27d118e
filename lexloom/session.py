"""Spark session settings, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; on a cluster leave master to spark-submit."""
    builder = SparkSession.builder.appName("lexloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lexloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name (not created) under the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Where it is unset, a local master, as in tests, uses a folder of
    this machine that goes when the process ends; on a cluster, whose machines don't see each other's folders, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


#: What shared_folder() has named in this process and discard() hasn't removed.
_named: list[str] = []


def named() -> tuple[str, ...]:
    """The folders that shared_folder() has named and that are still there."""
    return tuple(_named)


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    return saved_at(df, purpose)[0]


def saved_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """As saved(), and the folder, for discard() when no result needs it any more."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes folders of shared_folder(); without paths all that this process has named: call it so when its results are written.

    Spark removes the shuffle files of finished queries when the driver's objects for them are collected, so it is asked to.
    """
    for path in paths or tuple(_named):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        _named.remove(path)
    spark._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Executors collect their garbage and give the heap that is free then back to the system, as Python workers do at the end of a task.

    A heap that joins have filled stays as large as it was, and the workers of the next step come on top of it. The tasks
    are as many as run at once; one that misses an executor leaves it as it was.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def large_tasks(spark: SparkSession, gigabytes: int = 4) -> int:
    """How many tasks that take so much heap can run at once; at least one in each executor."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        return max(1, spark._jvm.Runtime.getRuntime().maxMemory() // (gigabytes << 30))
    return max(1, context._jsc.sc().getExecutorMemoryStatus().size() - 1) * max(1, context._jsc.sc().executorMemory() // (gigabytes << 10))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def makedirs(uri: str) -> None:
    if path := local_path(uri):
        os.makedirs(path, exist_ok=True)
