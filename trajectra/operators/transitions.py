"""Transition rates and substitution costs, as small tables keyed by state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import SequenceFrame

MOST_STATES = 2_000


def transition_counts(frame: SequenceFrame, lag: int = 1, by_time: bool = False) -> DataFrame:
    """([pos,] s1, s2, weight): weighted moves from s1 at pos to s2 at pos + lag. One shuffle by id."""
    by = Window.partitionBy("id").orderBy("pos")
    moved = frame.long.select("id", "pos", F.col("code").alias("s1"), F.lead("code", lag).over(by).alias("s2"), F.lead("pos", lag).over(by).alias("to"), "weight")
    moved = moved.where(F.col("s2").isNotNull() & (F.col("to") == F.col("pos") + lag))
    keys = ["pos", "s1", "s2"] if by_time else ["s1", "s2"]
    return moved.groupBy(*keys).agg(F.sum("weight").alias("weight"))


def transition_rates(frame: SequenceFrame, lag: int = 1, by_time: bool = False) -> DataFrame:
    """([pos,] s1, s2, rate) for the moves that occur; the rates from a state sum to one."""
    counts = transition_counts(frame, lag, by_time)
    by = Window.partitionBy(*(["pos"] if by_time else []), "s1")
    return counts.select(*([F.col("pos")] if by_time else []), "s1", "s2", (F.col("weight") / F.sum("weight").over(by)).alias("rate"))


def all_pairs(frame: SequenceFrame) -> DataFrame:
    """(s1, s2): all pairs of states; the alphabet bounds it."""
    k = frame.n_states
    if k > MOST_STATES:
        raise ValueError(f"{k} states make too large a cost table")
    spark = frame.long.sparkSession
    return spark.range(k * k).select((F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j")).select((F.col("i") + 1).alias("s1"), (F.col("j") + 1).alias("s2"))


def constant_costs(frame: SequenceFrame, value: float = 2.0) -> DataFrame:
    """(s1, s2, cost): ``value`` between different states."""
    return all_pairs(frame).withColumn("cost", F.when(F.col("s1") == F.col("s2"), 0.0).otherwise(float(value)))


def rate_costs(frame: SequenceFrame, value: float = 2.0, lag: int = 1) -> DataFrame:
    """(s1, s2, cost): value - P(s1 to s2) - P(s2 to s1)."""
    rates = transition_rates(frame, lag)
    there = rates.select("s1", "s2", F.col("rate").alias("r12"))
    back = rates.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), F.col("rate").alias("r21"))
    joined = all_pairs(frame).join(F.broadcast(there), ["s1", "s2"], "left").join(F.broadcast(back), ["s1", "s2"], "left")
    cost = F.lit(float(value)) - F.coalesce("r12", F.lit(0.0)) - F.coalesce("r21", F.lit(0.0))
    return joined.select("s1", "s2", F.when(F.col("s1") == F.col("s2"), 0.0).otherwise(cost).alias("cost"))


def rate_costs_by_time(frame: SequenceFrame, length: int, value: float = 4.0) -> DataFrame:
    """(pos, s1, s2, cost): time-varying; both neighbours' rates, or twice the one side's at the ends; 0 at least."""
    rates = transition_rates(frame, 1, by_time=True)
    spark = frame.long.sparkSession
    grid = spark.range(1, length + 1).select(F.col("id").cast("int").alias("pos")).join(all_pairs(frame), how="cross")  # alphabet squared times length
    cost = F.lit(0.0)
    for shift in (-1, 0):  # arriving at pos, and leaving it
        for a, b in (("s1", "s2"), ("s2", "s1")):
            name = f"r{shift + 1}{a}"
            side = rates.select((F.col("pos") - shift).alias("pos"), F.col("s1").alias(a), F.col("s2").alias(b), F.col("rate").alias(name))
            grid = grid.join(F.broadcast(side), ["pos", "s1", "s2"], "left")
            cost = cost + F.coalesce(name, F.lit(0.0))
    edge = (F.col("pos") == 1) | (F.col("pos") == length)
    whole = F.greatest(F.lit(0.0), float(value) - F.when(edge, 2 * cost).otherwise(cost))
    return grid.select("pos", "s1", "s2", F.when(F.col("s1") == F.col("s2"), 0.0).otherwise(whole).alias("cost"))


def future_costs(frame: SequenceFrame, lag: int = 1) -> DataFrame:
    """(s1, s2, cost): chi-square distance of the states' rate profiles, each target weighted by one over its rate sum."""
    k = frame.n_states
    rates = transition_rates(frame, lag)
    masses = rates.groupBy("s2").agg(F.sum("rate").alias("mass"))
    a, b = rates.select("s1", F.col("s2").alias("t"), F.col("rate").alias("p")), rates.select(F.col("s1").alias("s2"), F.col("s2").alias("t"), F.col("rate").alias("q"))
    targets = all_pairs(frame).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(k))))
    joined = targets.join(F.broadcast(a), ["s1", "t"], "left").join(F.broadcast(b), ["s2", "t"], "left").join(F.broadcast(masses.select(F.col("s2").alias("t"), "mass")), "t", "left")
    gap = F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))
    return joined.groupBy("s1", "s2").agg(F.sqrt(F.sum(F.when(F.col("mass") > 0, gap * gap / F.col("mass")).otherwise(0.0))).alias("cost"))


def indels(frame: SequenceFrame, log: bool = False) -> DataFrame:
    """(s, indel): 1 / share, or ln(2 / (1 + share)); an unseen state gets 1e15."""
    counts = frame.long.groupBy(F.col("code").alias("s")).agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy(F.lit(1)))  # a row per state
    share = F.coalesce("share", F.lit(0.0))
    spark = frame.long.sparkSession
    states = spark.range(1, frame.n_states + 1).select(F.col("id").cast("int").alias("s"))
    shares = states.join(F.broadcast(counts.select("s", (F.col("w") / total).alias("share"))), "s", "left")
    value = F.log(2 / (1 + share)) if log else F.when(share > 0, 1 / F.nullif(share, F.lit(0.0))).otherwise(1e15)
    return shares.select("s", value.alias("indel"))


def indel_costs(frame: SequenceFrame, log: bool = False) -> DataFrame:
    """(s1, s2, cost): the sum of the two states' indels."""
    one = indels(frame, log)
    joined = all_pairs(frame).join(F.broadcast(one.select(F.col("s").alias("s1"), F.col("indel").alias("i1"))), "s1").join(F.broadcast(one.select(F.col("s").alias("s2"), F.col("indel").alias("i2"))), "s2")
    return joined.select("s1", "s2", F.when(F.col("s1") == F.col("s2"), 0.0).otherwise(F.col("i1") + F.col("i2")).alias("cost"))


def feature_costs(frame: SequenceFrame, features: dict[str, list[float]], weights: dict[str, float] | None = None) -> DataFrame:
    """(s1, s2, cost): weighted Gower distance of the states' numeric features, each scaled by its range."""
    weights = weights or {}
    total = sum(weights.get(n, 1.0) for n in features)
    cost: Column = F.lit(0.0)
    for name, values in features.items():
        spread = max(values) - min(values)
        if spread:
            held = F.array(*[F.lit(float(v)) for v in values])
            cost = cost + weights.get(name, 1.0) / total * F.abs(F.get(held, F.col("s1") - 1) - F.get(held, F.col("s2") - 1)) / spread
    return all_pairs(frame).withColumn("cost", cost)


def default_indel(costs: list[float]) -> float:
    """Half the largest substitution cost."""
    return max(costs, default=0.0) / 2


def cost_matrix(costs: DataFrame, n_states: int) -> list[list[float]]:
    """The table as a matrix on the driver; the alphabet bounds it."""
    if n_states > MOST_STATES:
        raise ValueError("too many states for a matrix")
    out = [[0.0] * n_states for _ in range(n_states)]
    for row in costs.collect():
        if row.cost < 0 or math.isinf(row.cost):
            raise ValueError("costs must be finite and not negative")
        out[row.s1 - 1][row.s2 - 1] = row.cost
    return out
