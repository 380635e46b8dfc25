"""Structured Streaming forms: transition counts per window, sessions, and running per-id state.

The reference has no streams; these are the batch operators' counterparts for unbounded input, with
watermarks that bound their state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_counts(stream: DataFrame, ts: str, state: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(begin, state, n) per window of event time; rows later than ``late`` are left out."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(F.window(ts, window, slide) if slide else F.window(ts, window), F.col(state).alias("state")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("begin"), "state", "n")


def sessions(stream: DataFrame, id: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(id, begin, end, n): runs of an id's events with no gap as long as ``gap``."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(F.session_window(ts, gap), F.col(id).alias("id")).agg(F.count("*").alias("n"))
    return grouped.select("id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def transitions(stream: DataFrame, id: str, ts: str, state: str) -> DataFrame:
    """(id, ts, s1, s2): an id's moves, in order of arrival and of time within a batch; the state kept is an id's last one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        for batch in batches:
            rows = batch.sort_values(["ts", "s"])
            s1 = [last, *rows["s"].tolist()[:-1]]
            out = pd.DataFrame({"id": key[0], "ts": rows["ts"].to_numpy(), "s1": s1, "s2": rows["s"].to_numpy()})
            last = rows["s"].iloc[-1] if len(rows) else last
            yield out[out["s1"].notna()]
        if last is not None:
            held.update((last,))

    rows = stream.select(F.col(id).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.col(state).cast("string").alias("s"))
    return rows.groupBy("id").applyInPandasWithState(step, "id long, ts timestamp, s1 string, s2 string", "last string", "append", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a bounded stream to its end into a table in memory, for tests and small reports."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
