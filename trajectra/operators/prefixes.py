"""Divergence and convergence: prefixes and suffixes of sequences by position.

A prefix of t states is identified by a running hash of its states, built with one pass over each
row, so that counting prefixes groups 64-bit numbers instead of arrays. Suffixes are the same over
reversed sequences; ``pos`` of a suffix is the position at which it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.functions import spells as S

from .sequences import SequenceFrame


def _arrays(frame: SequenceFrame, spells: bool) -> DataFrame:
    return frame.arrays.select("id", S.distinct_successive(F.col("seq")).alias("seq") if spells else F.col("seq"))


def prefixes(frame: SequenceFrame, backward: bool = False, spells: bool = False) -> DataFrame:
    """(id, pos, depth, path, parent, code): each row's prefix (suffix) at each depth."""
    seq = F.reverse("seq") if backward else F.col("seq")
    zero = F.array(F.struct(F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("path"), F.lit(0).alias("code")))

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)["path"]
        return F.concat(a, F.array(F.struct(last.alias("parent"), F.xxhash64(last, x).alias("path"), x.alias("code"))))

    chain = F.aggregate(seq, zero, step, lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))))
    rows = _arrays(frame, spells).select("id", F.size("seq").alias("length"), F.posexplode(chain).alias("i", "x"))
    depth = F.col("i") + 1
    pos = F.col("length") - F.col("i") if backward else depth
    return rows.select("id", pos.alias("pos"), depth.alias("depth"), "x.path", "x.parent", "x.code")


def distinct_counts(frame: SequenceFrame, backward: bool = False, spells: bool = False) -> DataFrame:
    """(depth, n): distinct prefixes (suffixes) of each depth."""
    return prefixes(frame, backward, spells).groupBy("depth").agg(F.countDistinct("path").alias("n"))


def branching(frame: SequenceFrame, backward: bool = False, spells: bool = False) -> DataFrame:
    """(depth, factor): mean number of continuations of the prefixes one shorter; 0 at depth 1."""
    p = prefixes(frame, backward, spells)
    children = p.groupBy("depth", "parent").agg(F.countDistinct("path").alias("n"))
    return children.groupBy("depth").agg(F.when(F.col("depth") == 1, 0.0).otherwise(F.avg("n")).alias("factor"))


def substrings(frame: SequenceFrame, longest: int | None = None) -> DataFrame:
    """(depth, n): distinct runs of so many states in a row, at any position; of up to ``longest`` states, None is no limit."""
    depths = F.sequence(F.lit(1), F.size("seq") if longest is None else F.least(F.size("seq"), F.lit(longest)))
    each = frame.arrays.where(F.size("seq") > 0).select("seq", F.explode(depths).alias("depth"))
    runs = F.transform(F.sequence(F.lit(1), F.size("seq") - F.col("depth") + 1), lambda i: F.slice("seq", i, F.col("depth")))
    return each.select("depth", F.explode(runs).alias("run")).distinct().groupBy("depth").agg(F.count("*").alias("n"))


def js_distance(frame: SequenceFrame, backward: bool = False) -> DataFrame:
    """(pos, distance): Jensen-Shannon distance (natural log) of each cross-section to the one before, or after; 0 at the first (last)."""
    from .cross_section import state_distribution

    return _js(state_distribution(frame).select("pos", "code", F.col("share").alias("p")), backward)


def spell_js_distance(frame: SequenceFrame, power: float = 0.0, backward: bool = False) -> DataFrame:
    """(pos, distance): the same over the sequences' first, second, ... spells, which count their duration to the ``power``."""
    spells = frame.arrays.select("weight", F.posexplode(S.spells(F.col("seq"))).alias("i", "x"))
    mass = spells.groupBy((F.col("i") + 1).alias("pos"), F.col("x.state").alias("code")).agg(F.sum(F.col("weight") * F.pow(F.col("x.dur"), F.lit(power))).alias("w"))
    return _js(mass.select("pos", "code", (F.col("w") / F.sum("w").over(Window.partitionBy("pos"))).alias("p")), backward)  # a row per state and spell


def _js(dist: DataFrame, backward: bool) -> DataFrame:
    at = dist.agg((F.max("pos") if backward else F.min("pos")).alias("edge"))
    before = dist.select((F.col("pos") + (-1 if backward else 1)).alias("pos"), "code", F.col("p").alias("q")).join(dist.select("pos").distinct(), "pos", "left_semi")
    joined = dist.join(before, ["pos", "code"], "full").select("pos", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2

    def kl(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(0.0)

    total = joined.groupBy("pos").agg((F.sum(kl(F.col("p")) + kl(F.col("q"))) / 2).alias("s"))
    return total.join(F.broadcast(at), how="cross").select("pos", F.when(F.col("pos") == F.col("edge"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("s")))).alias("distance"))


def rarity(frame: SequenceFrame, backward: bool = False, spells: bool = False, group: DataFrame | None = None) -> DataFrame:
    """(id, pos, freq, rarity, z): -ln(share + 1e-10) of each prefix among the rows of its position, and its z-score.

    ``group``: (id, group), within which rows are compared.
    """
    p = prefixes(frame, backward, spells)
    keys = ["pos"]
    if group is not None:
        p, keys = p.join(group, "id"), ["group", "pos"]
    # Two-step counts: a path's rows are reduced before they meet.
    counts = p.groupBy(*keys, "path").agg(F.count("*").alias("freq"))
    totals = counts.groupBy(*keys).agg(F.sum("freq").alias("n"))
    value = -F.log(F.col("freq") / F.col("n") + 1e-10)
    held = counts.join(totals, keys).withColumn("rarity", value)
    moments = held.groupBy(*keys).agg(F.sum(F.col("freq") * F.col("rarity")).alias("s1"), F.sum(F.col("freq") * F.col("rarity") * F.col("rarity")).alias("s2"), F.first("n").alias("n_"), (F.max("rarity") > F.min("rarity")).alias("varies"))
    mean = F.col("s1") / F.col("n_")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("n_") * mean * mean) / F.nullif(F.col("n_") - 1, F.lit(0))))
    scored = held.join(moments.select(*keys, mean.alias("mean"), sd.alias("sd"), "varies"), keys)
    z = F.when(F.col("varies"), (F.col("rarity") - F.col("mean")) / F.col("sd"))
    return p.join(scored.select(*keys, "path", "freq", "rarity", z.alias("z")), [*keys, "path"]).select("id", *keys, "freq", "rarity", "z")


def rarity_scores(frame: SequenceFrame, backward: bool = False, spells: bool = False, group: DataFrame | None = None) -> DataFrame:
    """(id, score, unique_positions): summed rarity, and how many prefixes nobody else (of the group) has."""
    return rarity(frame, backward, spells, group).groupBy("id").agg(F.sum("rarity").alias("score"), F.count_if(F.col("freq") == 1).alias("unique_positions"))


def standardized_rarity(frame: SequenceFrame, backward: bool = False, first: int = 1, window: int = 1) -> DataFrame:
    """(id, score): the highest level of z that holds for ``window`` positions in a row, from position ``first``."""
    rows = rarity(frame, backward).where(F.col("pos") >= first)
    ahead = Window.partitionBy("id").orderBy("pos").rowsBetween(0, window - 1)
    held = rows.withColumn("low", F.when((F.count("z").over(ahead) == window), F.min("z").over(ahead)))
    return held.groupBy("id").agg(F.max("low").alias("score"))


def first_divergence(
    frame: SequenceFrame, backward: bool = False, method: str = "zscore", threshold: float = 1.5, first: int = 2, window: int = 2, proportion: float = 0.1, quantile: float = 0.9, inclusive: bool = False
) -> DataFrame:
    """(id, diverged, first_pos): whether and from where a row's prefixes are rare.

    ``zscore``: z over the threshold for ``window`` positions in a row; ``top_proportion``: the rows with the
    highest standardized scores; ``quantile``: scores at that quantile or above. Backward, suffixes that are
    common: signs turn round, so that ``diverged`` says converged.
    """
    sign = -1 if backward else 1
    ahead = Window.partitionBy("id").orderBy("pos").rowsBetween(0, window - 1)
    rows = rarity(frame, backward).where(F.col("pos") >= first).withColumn("z", F.col("z") * sign)
    low = rows.withColumn("low", F.when(F.count("z").over(ahead) == window, F.min("z").over(ahead)))
    everyone = frame.long.select("id").distinct()
    if method == "zscore":
        over = F.col("low") >= threshold if inclusive else F.col("low") > threshold
        found = low.where(over).groupBy("id").agg(F.min("pos").alias("first_pos"))
        return everyone.join(found, "id", "left").select("id", F.col("first_pos").isNotNull().alias("diverged"), "first_pos")
    scores = low.groupBy("id").agg(F.max("low").alias("score"))
    if method == "quantile":
        cut = scores.agg(F.percentile("score", F.lit(quantile)).alias("cut"))
        marked = scores.join(F.broadcast(cut), how="cross").where(F.col("score") >= F.col("cut"))
    elif method == "top_proportion":
        n = everyone.count()
        marked = scores.where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(max(1, int(proportion * n)))
    else:
        raise ValueError("method is zscore, top_proportion or quantile")
    found = low.join(marked.select("id", F.col("score").alias("own")), "id").where(F.col("low") == F.col("own")).groupBy("id").agg(F.min("pos").alias("first_pos"))
    return everyone.join(found, "id", "left").select("id", F.col("first_pos").isNotNull().alias("diverged"), "first_pos")


def score_thresholds(scores: DataFrame, group: DataFrame, quantile: float = 0.9) -> DataFrame:
    """(group, n, threshold): the quantile of (id, score) in each group of (id, group)."""
    return scores.where("score IS NOT NULL").join(group, "id").groupBy("group").agg(F.count("*").alias("n"), F.percentile("score", F.lit(quantile)).alias("threshold"))


def rarity_diagnostics(frame: SequenceFrame, backward: bool = False, spells: bool = False) -> DataFrame:
    """(pos, n, mean, sd, least, most, n_unique): the rarities of a position, which have no z-score where they don't vary."""
    rows = rarity(frame, backward, spells)
    return rows.groupBy("pos").agg(F.count("*").alias("n"), F.avg("rarity").alias("mean"), F.stddev_samp("rarity").alias("sd"), F.min("rarity").alias("least"), F.max("rarity").alias("most"), F.count_if(F.col("freq") == 1).alias("n_unique"))
