"""Gaps between two groups, decomposed over clusters of sequences and other covariates.

Each group's regression has a dummy for every cluster but one. Which one is left out would decide
what the clusters' coefficients mean, so coefficients are normalized: they are taken as deviations
from their mean over all clusters, and the mean goes to the constant. Every cluster then has a part
of its own. The data are read once: normal equations are sums by group, with generated dummies, and
a replicate of the bootstrap is a group more. The driver solves systems of as many unknowns as
there are clusters and covariates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import gram, unpacked

#: Clusters at most: a sum for each pair of them is computed.
MOST_CLUSTERS = 100
REFERENCES = ("group0", "group1", "pooled")


def owners(shares: Mapping, threshold: float = 50.0, neutral: int | None = 0, overrides: Mapping | None = None) -> dict:
    """Whose coefficient each cluster takes: 0, 1, or None for the reference. ``shares``: cluster to its shares in groups 0 and 1.

    A group owns a cluster if the other's share falls short of its own by more than ``threshold``
    percent; other clusters are ``neutral``'s.
    """
    found = {}
    for cluster, (a, b) in shares.items():
        short = 100.0 * abs(a - b) / max(a, b) if max(a, b) > 0 else 0.0
        found[cluster] = int(b > a) if short > threshold else neutral
    return found | {k: v for k, v in (overrides or {}).items() if k in found}


def _prepared(rows: DataFrame, target: str, group: str, cluster: str, columns: Sequence[str], weight: str | None) -> tuple[DataFrame, list]:
    """Rows without nulls, with a dummy for each cluster but the first, and the clusters in order."""
    own = [target, group, cluster, *columns, *([weight] if weight else [])]
    held = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in own))
    found = held.select(F.col(cluster).alias("c")).distinct().limit(MOST_CLUSTERS + 1).collect()
    clusters = sorted(r.c for r in found)
    if not 2 <= len(clusters) <= MOST_CLUSTERS:
        raise ValueError(f"there must be 2 to {MOST_CLUSTERS} clusters")
    return held.withColumns({f"__c{i}": (F.col(cluster) == F.lit(c)).cast("double") for i, c in enumerate(clusters) if i}), clusters


class Fit:
    """A group's means and coefficients: constant, covariates, and all clusters, normalized."""

    def __init__(self, xx: np.ndarray, xy: np.ndarray, covariates: int) -> None:
        self.xx, self.xy, self.covariates = xx, xy, covariates
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        self.mean_y = float(xy[0] / xx[0, 0])
        means = xx[0] / xx[0, 0]
        dummies = np.concatenate([[0.0], beta[1 + covariates :]])
        self.shares = np.concatenate([[1.0 - means[1 + covariates :].sum()], means[1 + covariates :]])
        self.means = np.concatenate([means[1 : 1 + covariates], self.shares])
        self.beta = np.concatenate([beta[1 : 1 + covariates], dummies - dummies.mean()])
        self.constant = float(beta[0] + dummies.mean())

    def with_(self, other: Fit) -> Fit:
        return Fit(self.xx + other.xx, self.xy + other.xy, self.covariates)


def _parts(zero: Fit, one: Fit, reference: str, owned: Sequence[int | None]) -> dict[str, np.ndarray]:
    """The parts of each covariate and cluster; ``owned``: of each, whose coefficient it takes, or None."""
    star = {"group0": zero, "group1": one, "pooled": zero.with_(one) if reference == "pooled" else zero}[reference].beta
    star = np.array([s if o is None else (zero, one)[o].beta[i] for i, (s, o) in enumerate(zip(star, owned, strict=True))])
    return {
        "gap": np.array([zero.mean_y - one.mean_y]),
        "constant": np.array([zero.constant - one.constant]),
        "explained": (zero.means - one.means) * star,
        "returns": zero.means * (zero.beta - star) + one.means * (star - one.beta),
    }


def _owned(zero: Fit, one: Fit, clusters: list, clusters_by: str, threshold: float, neutral: int | None, overrides: Mapping | None) -> list[int | None]:
    if clusters_by == "majority":
        by = owners({c: (a, b) for c, a, b in zip(clusters, zero.shares, one.shares, strict=True)}, threshold, neutral, overrides)
        return [None] * zero.covariates + [by[c] for c in clusters]
    fixed = {"group0": 0, "group1": 1, "pooled": None}[clusters_by]
    return [None] * zero.covariates + [(overrides or {}).get(c, fixed) for c in clusters]


def _fits(sums: Sequence, covariates: int, unknowns: int) -> tuple[Fit, Fit]:
    by = {int(g): Fit(*unpacked(s, unknowns)[:2], covariates) for g, s in sums}
    if set(by) != {0, 1}:
        raise ValueError("the group must be 0 and 1")
    return by[0], by[1]


def _references(clusters_by: str, reference: str) -> str:
    if clusters_by not in ("majority", *REFERENCES) or reference not in REFERENCES:
        raise ValueError("clusters take majority, group0, group1 or pooled; the reference is group0, group1 or pooled")
    return "pooled" if clusters_by == "pooled" else reference


def cluster_decomposition(
    rows: DataFrame, target: str, group: str, cluster: str, columns: Sequence[str] = (), weight: str | None = None, reference: str = "group0",
    clusters_by: str = "majority", threshold: float = 50.0, neutral: int | None = 0, overrides: Mapping | None = None,
) -> DataFrame:
    """(component, term, value): the gap of group 0's mean over group 1's, and its parts, overall and for each covariate and cluster.

    gap = constant + explained + returns, and the terms of each add up to it. ``clusters_by`` says
    whose coefficients weigh the clusters' shares: each cluster's owner (``owners``), or one for all;
    ``reference`` those of covariates and clusters without an owner. Rows with a null take no part.
    """
    reference = _references(clusters_by, reference)
    held, clusters = _prepared(rows, target, group, cluster, columns, weight)
    names = [*columns, *(f"__c{i}" for i in range(1, len(clusters)))]
    sums = gram(held, names, target, weight, [group]).collect()  # a row per group
    zero, one = _fits([(r[group], r.sums) for r in sums], len(columns), len(names) + 1)
    parts = _parts(zero, one, reference, _owned(zero, one, clusters, clusters_by, threshold, neutral, overrides))
    terms = [*columns, *(f"{cluster}={c}" for c in clusters)]
    out = [(component, None, float(values.sum())) for component, values in parts.items()]
    out += [(component, term, float(v)) for component in ("explained", "returns") for term, v in zip(terms, parts[component], strict=True)]
    return rows.sparkSession.createDataFrame(out, "component string, term string, value double")


def cluster_owners(rows: DataFrame, group: str, cluster: str, threshold: float = 50.0, neutral: int | None = 0) -> DataFrame:
    """(cluster, share0, share1, short, owner): each cluster's shares in both groups, by how many percent the lesser falls short, and whose it is."""
    held = rows.where(F.col(group).isNotNull() & F.col(cluster).isNotNull())
    n = {g: F.sum((F.col(group) == g).cast("double")) for g in (0, 1)}
    totals = held.agg(n[0].alias("t0"), n[1].alias("t1"))
    counts = held.groupBy(F.col(cluster).alias("cluster")).agg(n[0].alias("n0"), n[1].alias("n1")).join(F.broadcast(totals), how="cross")  # one row
    shares = counts.select("cluster", (F.col("n0") / F.col("t0")).alias("share0"), (F.col("n1") / F.col("t1")).alias("share1"))
    more = F.greatest("share0", "share1")
    short = F.when(more > 0, 100.0 * F.abs(F.col("share0") - F.col("share1")) / more).otherwise(0.0)
    return shares.withColumn("short", short).withColumn("owner", F.when(F.col("short") > threshold, (F.col("share1") > F.col("share0")).cast("int")).otherwise(F.lit(neutral).cast("int")))


def poisson_weight(seed: int, replicate: Column | str, id: str) -> Column:
    """0, 1, 2, ... as often as in draws with replacement; a hash of the seed, the replicate and the id decides."""
    u = (F.pmod(F.xxhash64(F.lit(seed), replicate, id), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    n, p, total = F.lit(0), 1 / np.e, 0.0
    for i in range(8):
        total += p
        n = n + (u > total).cast("int")
        p /= i + 1
    return n


def bootstrap_cluster_decomposition(
    rows: DataFrame, target: str, group: str, cluster: str, id: str, columns: Sequence[str] = (), replicates: int = 50, seed: int = 1, reference: str = "group0",
    clusters_by: str = "majority", threshold: float = 50.0, neutral: int | None = 0,
) -> DataFrame:
    """(component, term, mean, se, replicates) over draws of rows; owners are those of all rows. All replicates are summed in one pass.

    A replicate without one of the groups takes no part.
    """
    reference = _references(clusters_by, reference)
    held, clusters = _prepared(rows, target, group, cluster, columns, None)
    names = [*columns, *(f"__c{i}" for i in range(1, len(clusters)))]
    spread = held.withColumn("__replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    spread = spread.withColumn("__weight", F.when(F.col("__replicate") == 0, F.lit(1)).otherwise(poisson_weight(seed, "__replicate", id))).where("__weight > 0")
    by: dict[int, list] = {}
    for r in gram(spread, names, target, "__weight", ["__replicate", group]).collect():  # two rows per replicate
        by.setdefault(r["__replicate"], []).append((r[group], r.sums))
    whole = _fits(by.pop(0), len(columns), len(names) + 1)
    owned = _owned(*whole, clusters, clusters_by, threshold, neutral, None)
    terms = [*columns, *(f"{cluster}={c}" for c in clusters)]
    values: dict[tuple, list[float]] = {}
    for sums in by.values():
        if len(sums) < 2:
            continue
        for component, found in _parts(*_fits(sums, len(columns), len(names) + 1), reference, owned).items():
            values.setdefault((component, None), []).append(float(found.sum()))
            if component in ("explained", "returns"):
                for term, v in zip(terms, found, strict=True):
                    values.setdefault((component, term), []).append(float(v))
    out = [(c, t, float(np.mean(v)), float(np.std(v, ddof=1)) if len(v) > 1 else 0.0, len(v)) for (c, t), v in values.items()]
    return rows.sparkSession.createDataFrame(out, "component string, term string, mean double, se double, replicates int")
