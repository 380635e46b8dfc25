"""Pairs of trajectories by how their units are related, counted exactly and sampled by relation.

A trajectory belongs to a unit of each of two levels. The pairs of a relation are numbered without
being listed: trajectories are numbered level unit by level unit, so the pairs within units follow
one another, and a number tells its unit, by running sums of the units' pairs, and its two places in
it. A sample is a set of drawn numbers; those of another relation, which the exact counts say how
many to expect of, are drawn anew.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import SequenceFrame
from .tables import numbered, running, stored

RELATIONS = {"same_level_1": "level_1", "same_level_2": "level_2", "neither": None}
#: Where draws would be a larger part of all pairs than this, all are numbered and the first in a seeded order taken.
LARGE_PART = 0.25


def pair_counts(units: DataFrame) -> DataFrame:
    """(relation, n): how many pairs of trajectories share both levels' units, one, or neither. ``units``: (id, level_1, level_2)."""
    two = (F.col("m") * (F.col("m") - 1) / 2).cast("long")
    by = [units.groupBy(*keys).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(two), F.lit(0)).alias(name)) for keys, name in ((["level_1"], "a"), (["level_2"], "b"), (["level_1", "level_2"], "c"))]
    one = units.agg(F.count("*").alias("m")).select(two.alias("t"))
    for part in by:
        one = one.join(F.broadcast(part), how="cross")  # one row each
    names = {"same_pair": F.col("c"), "same_level_1": F.col("a") - F.col("c"), "same_level_2": F.col("b") - F.col("c"), "neither": F.col("t") - F.col("a") - F.col("b") + F.col("c")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("relation"), v.alias("n")) for k, v in names.items()])).alias("x")).select("x.*")


def sample_pairs(units: DataFrame, quotas: Mapping[str, int], seed: int = 1) -> DataFrame:
    """(relation, i, j): as many distinct pairs of each relation as its quota, or all, drawn uniformly; i comes before j in the order of units and ids."""
    if not quotas or set(quotas) - set(RELATIONS) or min(quotas.values()) < 0:
        raise ValueError(f"quotas are numbers of {tuple(RELATIONS)}")
    units = stored(units.select("id", "level_1", "level_2"))
    there = {r.relation: r.n for r in pair_counts(units).collect()}
    within = {"same_level_1": there["same_level_1"] + there["same_pair"], "same_level_2": there["same_level_2"] + there["same_pair"], "neither": sum(there.values())}
    out = None
    for relation, n in quotas.items():
        one = _sampled(units, relation, min(n, there[relation]), there[relation], within[relation], seed)
        out = one if out is None else out.unionByName(one)
    return out


def _sampled(units: DataFrame, relation: str, wanted: int, there: int, numbers: int, seed: int) -> DataFrame:
    """``wanted`` of the ``there`` pairs of a relation among ``numbers`` numbered ones."""
    spark = units.sparkSession
    level = RELATIONS[relation]
    places = stored(numbered(units, [level, "id"] if level else ["id"]))
    groups = _groups(places, level) if level else None
    draws = math.ceil(1.1 * wanted * numbers / max(1, there)) + 50
    own = F.xxhash64(F.lit(seed), F.lit(relation), F.col("rank"))
    while True:
        if draws >= LARGE_PART * numbers:
            ranks = spark.range(numbers).select(F.col("id").alias("rank"))
        else:
            ranks = spark.range(draws).select(F.pmod(F.xxhash64(F.lit(seed), F.lit(relation), F.lit("draw"), F.col("id")), F.lit(numbers)).alias("rank")).distinct()
        pairs = stored(_unranked(ranks, places, groups, level))
        right = stored(numbered(pairs.where(_related(relation)).withColumn("h", own), ["h", "rank"], "place").where(F.col("place") < wanted))
        if draws >= LARGE_PART * numbers or right.count() == wanted:
            return right.select(F.lit(relation).alias("relation"), "i", "j")
        draws *= 2


def _related(relation: str):
    one, two = F.col("a1").eqNullSafe(F.col("b1")), F.col("a2").eqNullSafe(F.col("b2"))
    return {"same_level_1": one & ~two, "same_level_2": two & ~one, "neither": ~one & ~two}[relation]


def _groups(places: DataFrame, level: str) -> DataFrame:
    """(ordinal, start, first): each unit with pairs, from 1, the place of its first trajectory and the number of its first pair."""
    sizes = places.groupBy(level).agg(F.min("n").alias("start"), F.count("*").alias("m")).where("m > 1").withColumn("pairs", F.expr("m * (m - 1) DIV 2"))
    summed = running(sizes, ["start"], {"end": "pairs", "ordinal": F.lit(1).cast("long")})
    return stored(summed.select("ordinal", "start", (F.col("end") - F.col("pairs")).alias("first")))


def _unranked(ranks: DataFrame, places: DataFrame, groups: DataFrame | None, level: str | None) -> DataFrame:
    """(rank, i, j, a1, a2, b1, b2): the pairs of these numbers, with their units."""
    if groups is None:
        placed = ranks.select("rank", F.lit(0).cast("long").alias("start"), F.col("rank").alias("r"))
    else:  # how many units begin up to a number is the ordinal of the one it is in
        both = groups.select(F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("unit")).unionByName(ranks.select(F.col("rank").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("unit")))
        known = running(both, ["at", "kind"], {"ordinal": "unit"}).where("kind = 1").select(F.col("at").alias("rank"), "ordinal")
        placed = known.join(groups, "ordinal").select("rank", "start", (F.col("rank") - F.col("first")).alias("r"))
    guess = placed.withColumn("q", F.floor((1 + F.sqrt(1 + 8 * F.col("r").cast("double"))) / 2).cast("long"))
    exact = guess.withColumn("q", F.expr("CASE WHEN q * (q - 1) DIV 2 > r THEN q - 1 WHEN q * (q + 1) DIV 2 <= r THEN q + 1 ELSE q END"))
    pairs = exact.select("rank", F.expr("start + r - q * (q - 1) DIV 2").alias("p"), F.expr("start + q").alias("q"))
    first = places.select(F.col("n").alias("p"), F.col("id").alias("i"), F.col("level_1").alias("a1"), F.col("level_2").alias("a2"))
    second = places.select(F.col("n").alias("q"), F.col("id").alias("j"), F.col("level_1").alias("b1"), F.col("level_2").alias("b2"))
    return pairs.join(first, "p").join(second, "q").select("rank", "i", "j", "a1", "a2", "b1", "b2")


def sampled_by_relation(frame: SequenceFrame, units: DataFrame, quotas: Mapping[str, int], seed: int = 1) -> DataFrame:
    """(relation, i, j, d): the share of positions in which sampled pairs differ, of those that both have; null if there are none."""
    pairs = sample_pairs(units, quotas, seed)
    rows = frame.arrays.select("id", "seq")
    both = pairs.join(rows.select(F.col("id").alias("i"), F.col("seq").alias("x")), "i").join(rows.select(F.col("id").alias("j"), F.col("seq").alias("y")), "j")
    missing = frame.missing_code or -1
    valid = F.filter(F.arrays_zip("x", "y"), lambda p: (p["x"] != missing) & (p["y"] != missing))
    d = F.size(F.filter(valid, lambda p: p["x"] != p["y"])) / F.nullif(F.size(valid), F.lit(0))
    return both.select("relation", "i", "j", d.alias("d"))


def contrast(distances: DataFrame) -> DataFrame:
    """(relation, n, mean, se, share): each relation's mean distance, and by what share it falls short of that of unrelated pairs."""
    means = distances.groupBy("relation").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"))
    base = means.where("relation = 'neither'").select(F.col("mean").alias("base"))
    return means.join(F.broadcast(base), how="left").select("relation", "n", "mean", "se", (1 - F.col("mean") / F.nullif("base", F.lit(0.0))).alias("share"))  # one row
