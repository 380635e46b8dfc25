"""A session with the settings that the engine's plans rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's own session is used as it is."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName("trajectra")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions or n))
    session = builder.getOrCreate()
    if not session.conf.get("spark.checkpoint.dir", None):  # stored tables need a folder; on one machine any will do
        session.stop()
        session = builder.config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='trajectra-')}").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
