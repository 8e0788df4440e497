"""Session settings and the shared folder used for stage boundaries."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: set[str] = set()


def build_session(app: str = "cadastra", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, ANSI and AQE on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Wide projections give methods the JVM refuses to compile; above this size Spark splits them.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for stages that every executor can reach, one for each application.

    It lies in ``spark.checkpoint.dir``; where that is unset, in the warehouse,
    which executors share as well. The stages are deleted when the driver's
    process ends, or earlier by ``drop_stages``.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get("spark.sql.warehouse.dir") + "/_stages"
    folder = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark, folder)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended already
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete all stages of this application; tables that read them end with it."""
    _delete(spark, shared_folder(spark))


def observed_stage(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, object]]:
    """``stage`` with aggregates of the rows, taken by the pass that writes them."""
    seen = Observation()
    staged = stage(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return staged, seen.get


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never sent whole through the driver.

    The optimizer measures a written or shuffled side by its compressed bytes.
    One that grows with the requests, in few different values, stays below
    ``spark.sql.autoBroadcastJoinThreshold`` with millions of rows, and the
    driver would unpack and hash them all.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt evenly over at least all cores and the usual number of shuffle partitions.

    A table read from a file has as many tasks as the file has splits, which is
    one for a small file of many rows, and so have the tables written from it.
    With ``keys`` that few rows share, rows go by their hash and need no sort.
    """
    return df.repartition(usual_tasks(df.sparkSession), *keys)


def usual_tasks(spark: SparkSession) -> int:
    """At least all cores and the usual number of shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that outlives executors, and gives the
    optimizer the real size of the result, so that a later join broadcasts it
    only when it is below ``spark.sql.autoBroadcastJoinThreshold`` and falls
    back to a shuffled, skew-split join when it is not. The shuffle files of the
    write are removed when it has ended, for nobody reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver give back the memory of stages that have ended, if its heap takes over half of what it may.

    A job of many small stages leaves plans, generated code and accounts of
    shuffles; the heap grows with them before they are collected, and with it
    what the driver's process holds.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()
