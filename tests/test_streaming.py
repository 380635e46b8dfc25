"""Streams give what the batch operators give on the same rows."""

from pyspark.sql import functions as F

from trajectra.streaming import live


def _source(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return batch


def test_transitions_of_a_stream(spark, sf_dir, tmp_path):
    batch = _source(spark, sf_dir)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = live.run_to_end(live.transitions(stream, "user_id", "ts", "event_type"), "moves")
    users = batch.select("user_id").distinct().count()
    assert out.count() == batch.count() - users


def test_window_counts_of_a_stream(spark, sf_dir, tmp_path):
    batch = _source(spark, sf_dir)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = live.run_to_end(live.state_counts(stream, "ts", "event_type", "1 day"), "counts", "complete")
    mine = {tuple(r) for r in out.collect()}
    assert mine == {tuple(r) for r in live.state_counts(batch, "ts", "event_type", "1 day").collect()}
