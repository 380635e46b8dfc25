"""Weighted statistics, feature extraction, and gap decompositions. Sums are gathered by Spark; only small solves are on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.functions import spells as S

from .sequences import SequenceFrame
from .tables import numbered, shuffles, stored


def weighted_moments(rows: DataFrame, value: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """([by,] n, weight, mean, variance, variance_ml): weighted mean, variance over W - 1 and over W."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    held = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), w.alias("__w"))
    agg = [F.count("*").alias("n"), F.sum("__w").alias("weight"), F.sum(F.col("__w") * F.col("__v")).alias("s"), F.sum(F.col("__w") * F.col("__v") * F.col("__v")).alias("q")]
    sums = held.groupBy(*by).agg(*agg) if by else held.agg(*agg)
    mean = F.col("s") / F.col("weight")
    ss = F.greatest(F.lit(0.0), F.col("q") - F.col("weight") * mean * mean)
    return sums.select(*by, "n", "weight", mean.alias("mean"), (ss / F.nullif(F.col("weight") - 1, F.lit(0.0))).alias("variance"), (ss / F.col("weight")).alias("variance_ml"))


def weighted_five_numbers(rows: DataFrame, value: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """([by,] p, value): 0, 25, 50, 75 and 100 percent, interpolated along cumulative weight.

    Values are reduced to distinct ones first, so the running sums are over those.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    held = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), w.alias("w")).groupBy(*by, "v").agg(F.sum("w").alias("w"))
    over = Window.partitionBy(*(by or [F.lit(1)]))
    up = over.orderBy("v")
    placed = held.withColumns({"c": F.sum("w").over(up), "total": F.sum("w").over(over)})
    at = (F.col("c") - F.col("w")) / F.nullif(F.col("total") - F.lit(1.0), F.lit(0.0)) if weight is None else (F.col("c") - F.col("w") / 2) / F.col("total")
    placed = placed.withColumn("at", F.coalesce(at, F.lit(0.0)))
    until = (F.col("c") - 1) / F.nullif(F.col("total") - 1, F.lit(0.0)) if weight is None else F.col("at")
    placed = placed.withColumn("until", F.coalesce(until, F.lit(0.0))).withColumns({"next_v": F.lead("v").over(up), "next_at": F.lead("at").over(up), "rank": F.row_number().over(up)})
    asked = placed.withColumn("p", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    inside = (F.col("p") >= F.col("at")) & (F.col("p") <= F.col("until"))
    between = (F.col("p") > F.col("until")) & (F.col("p") < F.col("next_at"))
    before = (F.col("rank") == 1) & (F.col("p") < F.col("at"))
    after = F.col("next_v").isNull() & (F.col("p") > F.col("until"))
    step = F.col("v") + (F.col("next_v") - F.col("v")) * (F.col("p") - F.col("until")) / (F.col("next_at") - F.col("until"))
    return asked.where(inside | between | before | after).select(*by, "p", F.when(between, step).otherwise(F.col("v")).alias("value")).groupBy(*by, "p").agg(F.min("value").alias("value"))


def duration_features(frame: SequenceFrame) -> DataFrame:
    """(id, dur_<state>...): time spent in each state."""
    counts = S.state_counts(F.col("seq"), frame.n_states)
    return frame.arrays.select("id", counts.alias("c")).select("id", *[F.get("c", F.lit(i)).alias(f"dur_{s}") for i, s in enumerate(frame.states)])


def timing_features(frame: SequenceFrame, width: int, length: int) -> DataFrame:
    """(id, start_<state>_<bin>..., end_<state>_<bin>...): whether a spell of the state starts, or ends, in the bin [a, a + width)."""
    bins = list(range(1, length + 1, width))
    spells = frame.arrays.select("id", F.explode(S.spells(F.col("seq"))).alias("x")).select("id", "x.state", "x.begin", (F.col("x.begin") + F.col("x.dur") - 1).alias("end"))
    columns = []
    for what in ("begin", "end"):
        for i, s in enumerate(frame.states, 1):
            for b in bins:
                hit = (F.col("state") == i) & (F.col(what) >= b) & (F.col(what) < b + width)
                columns.append(F.max(hit.cast("int")).alias(f"{'start' if what == 'begin' else 'end'}_{s}_{b}"))
    return spells.groupBy("id").agg(*columns)


def sequencing_features(frame: SequenceFrame, min_support: float, longest: int | None = None) -> DataFrame:
    """(id, pattern, has): frequent subsequences of state changes, by id; of up to ``longest`` events, None is no limit."""
    from . import events as E

    rows = E.from_states(frame, "state")
    found = E.frequent_subsequences(rows, min_support, longest)
    patterns = [[step[0] for step in E.parse_pattern(r.pattern)] for r in found.select("pattern").collect() if "," not in r.pattern]  # as many as are frequent
    return E.presence(rows, sorted(patterns)).withColumnRenamed("n", "has")


def gram(rows: DataFrame, columns: Sequence[str], target: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """([by,] sums): X'X, X'y, y'y and the weight, with a constant first, as one array per group. One pass, one small row per group."""
    names = ["__one", *columns]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = {n: F.lit(1.0) if n == "__one" else F.col(n).cast("double") for n in names}
    y = F.col(target).cast("double")
    cells = [F.sum(w * x[a] * x[b]) for i, a in enumerate(names) for b in names[i:]]
    cells += [F.sum(w * x[a] * y) for a in names] + [F.sum(w * y * y)]
    return rows.groupBy(*by).agg(F.array(*cells).alias("sums")) if by else rows.agg(F.array(*cells).alias("sums"))


def unpacked(sums: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    xx = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = sums[at]
            at += 1
    return xx, np.array(sums[at : at + k]), float(sums[at + k])


def regression(rows: DataFrame, columns: Sequence[str], target: str, weight: str | None = None) -> DataFrame:
    """(term, coefficient, se): weighted least squares from the sums."""
    k = len(columns) + 1
    xx, xy, yy = unpacked(gram(rows, columns, target, weight).first().sums, k)
    beta = np.linalg.solve(xx, xy)
    n = xx[0, 0]
    se = np.sqrt(np.maximum(0.0, np.diag(np.linalg.inv(xx)) * (yy - beta @ xy) / max(1e-12, n - k)))
    return rows.sparkSession.createDataFrame([(t, float(b), float(s)) for t, b, s in zip(["constant", *columns], beta, se, strict=True)], "term string, coefficient double, se double")


def oaxaca_blinder(rows: DataFrame, columns: Sequence[str], target: str, group: str, weight: str | None = None, reference: str = "pooled") -> DataFrame:
    """(component, value): the groups' mean gap, and the parts due to characteristics, returns and the constant.

    ``group`` is 0 or 1, the gap is 0's mean less 1's. ``reference``: whose coefficients weigh the
    characteristics: group0, group1 or pooled.
    """
    k = len(columns) + 1
    parts = {int(r[group]): unpacked(r.sums, k) for r in gram(rows, columns, target, weight, [group]).collect()}  # a row per group
    if set(parts) != {0, 1}:
        raise ValueError("the group must be 0 and 1")
    means, betas = {}, {}
    for g, (xx, xy, _) in parts.items():
        means[g] = xx[0] / xx[0, 0]
        betas[g] = np.linalg.solve(xx, xy)
    pooled = np.linalg.solve(parts[0][0] + parts[1][0], parts[0][1] + parts[1][1])
    star = {"group0": betas[0], "group1": betas[1], "pooled": pooled}[reference]
    gap = float(means[0] @ betas[0] - means[1] @ betas[1])
    explained = (means[0] - means[1]) * star
    returns = means[0] * (betas[0] - star) + means[1] * (star - betas[1])
    out = [("gap", gap), ("explained", float(explained.sum())), ("returns", float(returns[1:].sum())), ("constant", float(returns[0]))]
    out += [(f"explained_{c}", float(v)) for c, v in zip(columns, explained[1:], strict=True)]
    out += [(f"returns_{c}", float(v)) for c, v in zip(columns, returns[1:], strict=True)]
    return rows.sparkSession.createDataFrame(out, "component string, value double")


def bootstrap_oaxaca(rows: DataFrame, columns: Sequence[str], target: str, group: str, id: str, replicates: int = 50, seed: int = 1, reference: str = "pooled") -> DataFrame:
    """(component, mean, se) over replicates with Poisson(1) weights by seeded hashes; all replicates are one grouped pass."""
    k = len(columns) + 1
    u = (F.pmod(F.xxhash64(F.lit(seed), "replicate", id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cut, p, total = F.lit(0), 1 / np.e, 0.0
    for n in range(8):
        total += p
        cut = cut + (u > total).cast("int")
        p /= n + 1
    spread = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("__w", cut)
    found: dict[int, dict] = {}
    for r in gram(spread, columns, target, "__w", ["replicate", group]).collect():  # two rows per replicate
        found.setdefault(r.replicate, {})[int(r[group])] = unpacked(r.sums, k)
    values: dict[str, list[float]] = {}
    for parts in found.values():
        if set(parts) != {0, 1}:
            continue
        b = {g: np.linalg.lstsq(xx, xy, rcond=None)[0] for g, (xx, xy, _) in parts.items()}
        m = {g: xx[0] / xx[0, 0] for g, (xx, _, _) in parts.items()}
        star = np.linalg.lstsq(parts[0][0] + parts[1][0], parts[0][1] + parts[1][1], rcond=None)[0] if reference == "pooled" else b[0 if reference == "group0" else 1]
        values.setdefault("gap", []).append(float(m[0] @ b[0] - m[1] @ b[1]))
        values.setdefault("explained", []).append(float((m[0] - m[1]) @ star))
    out = [(c, float(np.mean(v)), float(np.std(v, ddof=1)) if len(v) > 1 else 0.0) for c, v in sorted(values.items())]
    return rows.sparkSession.createDataFrame(out, "component string, mean double, se double")


def _correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where a column doesn't vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def cluster_composition(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster, group, n, share): each group's share of clusters."""
    counts = labels.join(groups, "id").groupBy("cluster", "group").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("group")))


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns; one pass."""
    names = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[_correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(names)])).alias("x")).select("x.a", "x.b", "x.r")


def relevant_features(rows: DataFrame, columns: Sequence[str], target: str, rounds: int = 20, seed: int = 1, key: str | None = None) -> DataFrame:
    """(feature, hits, relevant): how often a feature's absolute correlation with the target beats that of the best shuffled copy.

    A shuffled copy meets the target in a seeded order; a feature is relevant if it wins more often than a fair coin
    would in 95 of 100 cases. Rows are numbered by ``key``, or by their values, so the draws are the same each time.
    """
    from math import comb

    own = rows.agg(*[F.abs(_correlation(c, target)).alias(c) for c in columns]).first()
    order = [key] if key else [F.xxhash64(*columns, target), *columns, target]
    places = stored(numbered(rows.select(*dict.fromkeys([*([key] if key else []), *columns, target])), order, "__n"))
    n = places.count()
    hits = dict.fromkeys(columns, 0)
    others = places.select(F.col("__n").alias("__m"), F.col(target).alias("__t"))
    turns = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b")) for r, (a, b) in enumerate(shuffles(n, rounds, seed))])
    mixed = places.select("__n", *columns, F.explode(turns).alias("x")).withColumn("__m", F.pmod(F.col("__n") * F.col("x.a") + F.col("x.b"), F.lit(n))).join(others, "__m")
    for row in mixed.groupBy("x.r").agg(*[F.abs(_correlation(c, "__t")).alias(f"c{i}") for i, c in enumerate(columns)]).collect():  # a row per round
        best = max((row[f"c{i}"] or 0.0) for i in range(len(columns)))
        for c in columns:
            hits[c] += int((own[c] or 0.0) > best)
    least = next(h for h in range(rounds + 1) if sum(comb(rounds, x) for x in range(h, rounds + 1)) / 2**rounds <= 0.05)
    return rows.sparkSession.createDataFrame([(c, h, h >= least) for c, h in hits.items()], "feature string, hits int, relevant boolean")
