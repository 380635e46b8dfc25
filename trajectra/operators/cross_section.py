"""Cross-sectional indicators: distributions, entropy and modal states by position, mean times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import SequenceFrame


def _states(frame: SequenceFrame) -> DataFrame:
    return frame.long.sparkSession.range(1, frame.n_states + 1).select(F.col("id").cast("int").alias("code"))


def state_distribution(frame: SequenceFrame) -> DataFrame:
    """(pos, code, weight, share), with zeros for states that a position doesn't have."""
    counts = frame.long.groupBy("pos", "code").agg(F.sum("weight").alias("weight"))
    grid = counts.select("pos").distinct().join(F.broadcast(_states(frame)), how="cross")  # positions times the alphabet
    filled = grid.join(counts, ["pos", "code"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return filled.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("pos")))


def entropy_by_position(frame: SequenceFrame, normalized: bool = True) -> DataFrame:
    """(pos, n_valid, entropy, effective_states): Shannon entropy of each cross-section."""
    import math

    plogp = F.when(F.col("share") > 0, -F.col("share") * F.log("share")).otherwise(0.0)
    per = state_distribution(frame).groupBy("pos").agg(F.sum("weight").alias("n_valid"), F.sum(plogp).alias("h"))
    scale = math.log(frame.n_states) if normalized and frame.n_states > 1 else 1.0
    return per.select("pos", "n_valid", (F.col("h") / scale).alias("entropy"), F.exp("h").alias("effective_states"))


def modal_states(frame: SequenceFrame) -> DataFrame:
    """(pos, code, share): the most frequent state of each position; the least code of equal ones."""
    top = state_distribution(frame).groupBy("pos").agg(F.max(F.struct("share", (-F.col("code")).alias("c"))).alias("x"))
    return top.select("pos", (-F.col("x.c")).alias("code"), F.col("x.share").alias("share"))


def modal_occurrences(frame: SequenceFrame) -> DataFrame:
    """(n): how many sequences are the modal sequence itself."""
    modal = modal_states(frame).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("x")).select(F.col("x.code").alias("seq"))  # a row per position
    return frame.arrays.join(F.broadcast(modal), "seq").agg(F.count("*").alias("n"))


def mean_time(frame: SequenceFrame) -> DataFrame:
    """(code, mean, variance, sd, se): weighted time spent in each state; states without time count as zero."""
    spent = frame.long.groupBy("id", "code").agg(F.count("*").cast("double").alias("t"), F.first("weight").alias("w"))
    sums = spent.groupBy("code").agg(F.sum(F.col("w") * F.col("t")).alias("wt"), F.sum(F.col("w") * F.col("t") * F.col("t")).alias("wtt"))
    people = frame.long.groupBy("id").agg(F.first("weight").alias("w")).agg(F.sum("w").alias("W"), F.sum(F.col("w") * F.col("w")).alias("W2"))
    joined = _states(frame).join(F.broadcast(sums), "code", "left").join(F.broadcast(people), how="cross").na.fill(0.0, ["wt", "wtt"])
    mean = F.col("wt") / F.col("W")
    variance = (F.col("wtt") - F.col("W") * mean * mean) * F.col("W") / (F.col("W") * F.col("W") - F.col("W2"))
    out = joined.select("code", mean.alias("mean"), F.greatest(F.lit(0.0), variance).alias("variance"), "W")
    return out.select("code", "mean", "variance", F.sqrt("variance").alias("sd"), F.sqrt(F.col("variance") / F.col("W")).alias("se"))


def most_frequent(frame: SequenceFrame, top: int = 10) -> DataFrame:
    """(seq, weight, share): the ``top`` most frequent sequences, equal ones in order of their states."""
    whole = frame.long.groupBy("id").agg(F.first("weight").alias("w")).agg(F.sum("w").alias("W"))
    ranked = frame.unique.orderBy(F.desc("weight"), "seq").limit(top)
    return ranked.join(F.broadcast(whole), how="cross").select("seq", "weight", (F.col("weight") / F.col("W")).alias("share"))
