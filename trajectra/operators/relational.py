"""Relational sequences: trajectories of pairs of units at two levels, and how their distances split by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import distances as D
from .sequences import SequenceFrame, build
from .tables import numbered, reads_pairs_often, stored


def make(rows: DataFrame, level_1: str, level_2: str, time: str, state: str, states: list[str]) -> tuple[SequenceFrame, DataFrame]:
    """The pairs' sequence table, and (id, level_1, level_2); the id is a hash of both, and positions follow the times."""
    pair = F.xxhash64(F.col(level_1).cast("string"), F.col(level_2).cast("string"))
    times = sorted(r[0] for r in rows.select(time).distinct().collect())  # the time grid
    keyed = rows.withColumn("__id", pair).withColumn("__pos", F.array_position(F.array(*map(F.lit, times)), F.col(time)))
    units = keyed.select(F.col("__id").alias("id"), F.col(level_1).alias("level_1"), F.col(level_2).alias("level_2")).distinct()
    return build(keyed, "__id", "__pos", state, states), units


def check_panel(rows: DataFrame, level_1: str, level_2: str, time: str) -> DataFrame:
    """(n_pairs, n_repeated, balanced): repeated (pair, time) rows, and whether every pair has every time."""
    per = rows.groupBy(level_1, level_2).agg(F.count("*").alias("n"), F.countDistinct(time).alias("t"))
    grid = rows.agg(F.countDistinct(time).alias("all_times"))
    return per.join(F.broadcast(grid), how="cross").agg(F.count("*").alias("n_pairs"), F.sum(F.col("n") - F.col("t")).alias("n_repeated"), F.bool_and(F.col("t") == F.col("all_times")).alias("balanced"))


def relation_of(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(i, j, d, relation): which levels two pairs of units share; ``pairs`` over the units' ids."""
    a, b = units.select(F.col("id").alias("i"), F.col("level_1").alias("a1"), F.col("level_2").alias("a2")), units.select(F.col("id").alias("j"), F.col("level_1").alias("b1"), F.col("level_2").alias("b2"))
    one, two = F.col("a1") == F.col("b1"), F.col("a2") == F.col("b2")
    name = F.when(one & two, "same_pair").when(one, "same_level_1").when(two, "same_level_2").otherwise("neither")
    return pairs.join(a, "i").join(b, "j").select("i", "j", "d", name.alias("relation"))


def distance_by_structure(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(relation, n, mean, sd) of the distances."""
    return relation_of(pairs, units).groupBy("relation").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))


@reads_pairs_often
def discrepancy_by_level(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(level, pseudo_r2, pseudo_f) of level_1 and level_2 as factors."""
    from .discrepancy import association

    out = None
    for level in ("level_1", "level_2"):
        one = association(pairs, units.select("id", F.lit(1.0).alias("weight"), F.col(level).alias("group"))).select(F.lit(level).alias("level"), "pseudo_r2", "pseudo_f")
        out = one if out is None else out.unionByName(one)
    return out


@reads_pairs_often
def crossed_discrepancy(pairs: DataFrame, units: DataFrame, rounds: int = 50) -> DataFrame:
    """(term, share): shares of the mean distance that level_1, level_2 and their cell leave out, by backfitted means of pairs' distances to all."""
    effects = additive_effects(pairs, units, rounds)
    total = F.sum(F.col("m") * F.col("m"))
    sums = effects.agg(total.alias("all"), F.sum(F.col("e1") * F.col("e1")).alias("a"), F.sum(F.col("e2") * F.col("e2")).alias("b"), F.sum(F.col("rest") * F.col("rest")).alias("r"))
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), (F.col(c) / F.nullif(F.col("all"), F.lit(0.0))).alias("share")) for n, c in (("level_1", "a"), ("level_2", "b"), ("residual", "r"))])).alias("x")
    return sums.select("all", parts).select("x.term", "x.share")


@reads_pairs_often
def additive_effects(pairs: DataFrame, units: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, level_1, level_2, m, e1, e2, rest): each pair's mean distance to all others, centred, and its split into level effects.

    On a balanced grid the level means are the least-squares effects at once; else they are
    refitted by turns, on tables of units, for ``rounds`` rounds or until they settle.
    """
    n = units.count()
    means = D.both_ways(pairs).groupBy("i").agg((F.sum("d") / max(1, n - 1)).alias("x"))
    rows = units.join(means.withColumnRenamed("i", "id"), "id", "left").na.fill(0.0, ["x"])
    grand = rows.agg(F.avg("x").alias("g"))
    rows = rows.join(F.broadcast(grand), how="cross").select("id", "level_1", "level_2", (F.col("x") - F.col("g")).alias("m"))
    cells = [(r.level_1, r.level_2, r.m) for r in rows.select("level_1", "level_2", "m").toLocalIterator()] if n <= 100_000 else None
    if cells is None:
        raise ValueError("effects are fitted for 100,000 pairs of units at most")
    e1, e2 = dict.fromkeys({c[0] for c in cells}, 0.0), dict.fromkeys({c[1] for c in cells}, 0.0)
    for _ in range(rounds):
        before = dict(e1)
        for own, other, at in ((e1, e2, 0), (e2, e1, 1)):
            sums: dict = {}
            for c in cells:
                s = sums.setdefault(c[at], [0.0, 0])
                s[0] += c[2] - other[c[1 - at]]
                s[1] += 1
            own.update({key: s / k for key, (s, k) in sums.items()})
        if max(abs(e1[x] - before[x]) for x in e1) < 1e-12:
            break
    spark = units.sparkSession
    t1, t2 = units.schema["level_1"].dataType.simpleString(), units.schema["level_2"].dataType.simpleString()
    f1 = spark.createDataFrame(sorted(e1.items()), f"level_1 {t1}, e1 double")
    f2 = spark.createDataFrame(sorted(e2.items()), f"level_2 {t2}, e2 double")
    return rows.join(f1, "level_1").join(f2, "level_2").select("id", "level_1", "level_2", "m", "e1", "e2", (F.col("m") - F.col("e1") - F.col("e2")).alias("rest"))


@reads_pairs_often
def outliers(pairs: DataFrame, units: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(id, level_1, level_2, rest, z): pairs whose mean distance the level effects don't explain."""
    effects = additive_effects(pairs, units)
    moments = effects.agg(F.avg("rest").alias("mean"), F.stddev_samp("rest").alias("sd"))
    z = (F.col("rest") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return effects.join(F.broadcast(moments), how="cross").select("id", "level_1", "level_2", "rest", z.alias("z")).where(F.abs("z") >= threshold)


def unit_profiles(pairs: DataFrame, units: DataFrame, level: str = "level_1") -> DataFrame:
    """(unit, n_pairs, within, to_others): a unit's trajectories, their mean distance among themselves and to those of other units."""
    a, b = units.select(F.col("id").alias("i"), F.col(level).alias("u")), units.select(F.col("id").alias("j"), F.col(level).alias("v"))
    both = D.both_ways(pairs).join(a, "i").join(b, "j")
    sums = both.groupBy("u").agg(F.avg(F.when(F.col("u") == F.col("v"), F.col("d"))).alias("within"), F.avg(F.when(F.col("u") != F.col("v"), F.col("d"))).alias("to_others"))
    sizes = units.groupBy(F.col(level).alias("unit")).agg(F.count("*").alias("n_pairs"))
    return sizes.join(sums.withColumnRenamed("u", "unit"), "unit", "left").select("unit", "n_pairs", "within", "to_others")


def unit_distances(pairs: DataFrame, units: DataFrame, level: str = "level_1") -> DataFrame:
    """(u, v, d): mean distance of two units' trajectories."""
    a, b = units.select(F.col("id").alias("i"), F.col(level).alias("x")), units.select(F.col("id").alias("j"), F.col(level).alias("y"))
    return pairs.join(a, "i").join(b, "j").where("x <> y").groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.avg("d").alias("d"))


def sampled_distances(frame: SequenceFrame, units: DataFrame, partners: int = 8, seed: int = 1) -> DataFrame:
    """(i, j, d, relation): Hamming distances of each pair of units to some others, drawn uniformly by seeded hashes, without the full table.

    Missing states are left out, and the distance is over the positions that both have.
    """
    rows = frame.arrays.select("id", "seq")
    n = rows.count()
    places = stored(numbered(rows, ["id"]))
    drawn = places.select(F.col("id").alias("i"), F.col("seq").alias("x"), "n", F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("k"))
    drawn = drawn.withColumn("m", F.pmod(F.col("n") + 1 + F.pmod(F.xxhash64(F.lit(seed), "i", "k"), F.lit(max(1, n - 1))), F.lit(n)))
    both = drawn.join(places.select(F.col("id").alias("j"), F.col("seq").alias("y"), F.col("n").alias("m")), "m")
    missing = frame.missing_code or -1
    valid = F.filter(F.arrays_zip("x", "y"), lambda p: (p["x"] != missing) & (p["y"] != missing))
    d = F.size(F.filter(valid, lambda p: p["x"] != p["y"])) / F.nullif(F.size(valid), F.lit(0))
    return relation_of(both.select("i", "j", d.alias("d")), units)


def compressed(frame: SequenceFrame) -> DataFrame:
    """(pattern, n, weight, first_id): identical trajectories as one, with how many pairs of units and how much weight have them."""
    return frame.arrays.groupBy("seq").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("id").alias("first_id")).select(F.array_join(F.col("seq").cast("array<string>"), "-").alias("pattern"), "n", "weight", "first_id")


@reads_pairs_often
def level_test(pairs: DataFrame, units: DataFrame, replicates: int = 49, seed: int = 1) -> DataFrame:
    """(level, statistic, value, p_value) of level_1 and level_2 as factors, by permutation."""
    from .discrepancy import association_test

    out = None
    for level in ("level_1", "level_2"):
        one = association_test(pairs, units.select("id", F.lit(1.0).alias("weight"), F.col(level).alias("group")), replicates, seed).select(F.lit(level).alias("level"), "statistic", "value", "p_value")
        out = one if out is None else out.unionByName(one)
    return out


@reads_pairs_often
def cluster_units(pairs: DataFrame, units: DataFrame, k: int, level: str = "level_1") -> DataFrame:
    """(unit, cluster): k-medoids of a level's units by the mean distances of their trajectories."""
    from .clustering import k_medoids

    names = stored(numbered(units.select(F.col(level).alias("unit")).distinct(), ["unit"], "id"))
    apart = unit_distances(pairs, units, level)
    coded = apart.join(names.select(F.col("unit").alias("u"), F.col("id").alias("a")), "u").join(names.select(F.col("unit").alias("v"), F.col("id").alias("b")), "v")
    coded = coded.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "d")
    return k_medoids(coded, names.select("id", F.lit(1.0).alias("weight")), k).join(names, "id").select("unit", "cluster")
