"""Shared scratch tables: lineage is cut by a table written where every executor can read it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an error where it is unset, as no other folder is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share when the session is made")
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder, below one folder for the application."""
    return f"{shared_dir(spark)}/trajectra/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it.

    Later stages then neither recompute it nor depend on executors' local files, so the write's
    shuffle files are deleted at its end. The tables go with :func:`discard` and :func:`release`,
    or with the shared folder's own retention.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """From now on Python gets so many rows at once at most: texts may be long, and workers keep the memory they once took."""
    if int(spark.conf.get(BATCH_ROWS)) not in range(1, rows + 1):
        spark.conf.set(BATCH_ROWS, str(rows))


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables of which nothing is still to be read."""
    for table in tables:
        if path := getattr(table, "_scratch_path", None):
            _delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it once no result of them is still to be read."""
    _delete(spark, f"{shared_dir(spark)}/trajectra/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
