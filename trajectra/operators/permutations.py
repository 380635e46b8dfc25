"""Permutation tests of groups under four ways to treat weights, for many sets of rows at once.

A replicate deals out a set's rows anew, and its statistic follows from each group's weighted sum of
distances between its rows. All sets' replicates are summed in one narrow pass over the pair table:
a task holds a weight per row, group and replicate, and gives a row of sums per set, which are added
up by set. More replicates than fit are taken in further passes.

``weights``:

* ``diss``: a row keeps its weight, and groups are permuted;
* ``group``: weights go with the groups;
* ``replicate``: a row of weight w is w cases, each dealt out on its own. How many of a row's cases a
  group gets is drawn from the groups' sizes, so rows aren't repeated; weights are rounded;
* ``none``: each row weighs 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mismatches import Mismatches
from .tables import reads_pairs_often

WEIGHTS = ("diss", "group", "replicate", "none")
#: Weights by row, group and replicate that travel with the tasks at once.
MOST_DEALT = 6_000_000


def dealt(weight: np.ndarray, group: np.ndarray, groups: int, replicates: int, weights: str, rng: np.random.Generator) -> np.ndarray:
    """(groups, rows, replicates + 1): the weight of each row in each group, first as it is and then as dealt out."""
    if weights not in WEIGHTS:
        raise ValueError(f"weights are one of {WEIGHTS}")
    n = len(weight)
    own = np.ones(n) if weights == "none" else np.maximum(0, np.rint(weight)) if weights == "replicate" else weight
    out = np.zeros((groups, n, replicates + 1))
    out[group, np.arange(n), 0] = own
    for r in range(1, replicates + 1):
        if weights == "replicate":
            left = own.astype(np.int64)
            for g in range(groups):
                size = int(own[group == g].sum())
                drawn = rng.multivariate_hypergeometric(left, size, method="marginals") if g < groups - 1 else left
                out[g, :, r], left = drawn, left - drawn
        else:
            order = rng.permutation(n)
            out[group[order], np.arange(n), r] = own[order] if weights == "group" else own
    return out


def set_sums(pairs: DataFrame | Mismatches, ids: np.ndarray, sets: np.ndarray, shares: np.ndarray) -> dict[int, np.ndarray]:
    """Of each set (groups + 1, replicates): for every group, and all rows, the sum of w_i w_j d over the set's pairs. ``ids`` are in order."""
    if isinstance(pairs, Mismatches):
        return pairs.set_sums(ids, sets, shares)
    n_groups, _, width = shares.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shares.sum(axis=0)
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            i, j = (batch.column(c).to_numpy() for c in ("i", "j"))
            a, b = np.minimum(np.searchsorted(ids, i), len(ids) - 1), np.minimum(np.searchsorted(ids, j), len(ids) - 1)
            inside = np.flatnonzero((ids[a] == i) & (ids[b] == j) & (sets[a] == sets[b]))
            a, b, d = a[inside], b[inside], batch.column("d").to_numpy()[inside]
            for s in np.unique(sets[a]):
                own = np.flatnonzero(sets[a] == s)
                x, y, w = a[own], b[own], d[own][:, None]
                one = np.stack([*((shares[g][x] * shares[g][y] * w).sum(axis=0) for g in range(n_groups)), (total[x] * total[y] * w).sum(axis=0)])
                found[int(s)] = found[int(s)] + one if int(s) in found else one
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.ravel().tolist() for v in found.values()], pa.list_(pa.float64()))], names=["set", "s"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"set": table.column("set")[:1], "s": pa.array([np.sum([np.asarray(x) for x in table.column("s").to_pylist()], axis=0).tolist()], pa.list_(pa.float64()))})

    rows = pairs.select("i", "j", "d").mapInArrow(sums, "set long, s array<double>").groupBy("set").applyInArrow(add, "set long, s array<double>").collect()  # a row per set
    return {r["set"]: np.array(r.s).reshape(n_groups + 1, width) for r in rows}


def _pseudo_f(sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """F and the share explained from (groups + 1, replicates) sums and (groups, replicates) weights."""
    k, total = (sizes > 0).sum(axis=0), sizes.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        within = np.where(sizes > 0, sums[:-1] / sizes, 0.0).sum(axis=0)
        ss = sums[-1] / total
        return (ss - within) / (k - 1) / (within / (total - k)), 1 - within / ss


@reads_pairs_often
def set_tests(pairs: DataFrame, rows: DataFrame, replicates: int = 99, seed: int = 1, weights: str = "diss") -> DataFrame:
    """(set, groups, pseudo_f, pseudo_r2, p_value): whether groups differ within each set of ``rows`` (id, weight, set, group).

    ``p_value`` is the share of replicates, the observed one included, with an F as large; null where
    F isn't defined. Pairs of rows of different sets play no part.
    """
    spark = rows.sparkSession
    held = rows.select(F.col("id").cast("long").alias("id"), F.col("weight").cast("double").alias("weight"), F.col("set").cast("long").alias("set"), F.col("group").cast("string").alias("group")).orderBy("id").toArrow()  # a row per id of a quadratic table
    ids, weight, sets = (held.column(c).to_numpy() for c in ("id", "weight", "set"))
    out = []
    if len(ids):
        names = held.column("group").to_pylist()
        group = np.zeros(len(ids), np.int64)
        most = 0
        for s in np.unique(sets):  # groups are numbered within each set
            own = np.flatnonzero(sets == s)
            kinds = {g: i for i, g in enumerate(sorted({names[i] for i in own}, key=str))}
            group[own] = [kinds[names[i]] for i in own]
            most = max(most, len(kinds))
        step = max(1, MOST_DEALT // (len(ids) * most))
        values: dict[int, list] = {}
        known: dict[int, tuple] = {}
        for at in range(0, replicates, step):
            width = min(step, replicates - at)
            shares = np.zeros((most, len(ids), width + 1))
            for s in np.unique(sets):
                own = np.flatnonzero(sets == s)
                shares[:, own] = dealt(weight[own], group[own], most, width, weights, np.random.default_rng([seed, at, int(s) & 0x7FFFFFFF]))
            sums = set_sums(pairs, ids, sets, shares)
            for s in np.unique(sets).tolist():
                f, r2 = _pseudo_f(sums.get(s, np.zeros((most + 1, width + 1))), shares[:, sets == s].sum(axis=1))
                known[s] = int((shares[:, sets == s, 0].sum(axis=1) > 0).sum()), float(f[0]), float(r2[0])
                values.setdefault(s, []).append(f[1:])
        for s, (k, f, r2) in known.items():
            drawn = np.concatenate(values[s])
            p = float((1 + (drawn >= f - 1e-12).sum()) / (1 + len(drawn))) if np.isfinite(f) else None
            out.append((s, k, f if np.isfinite(f) else None, r2 if np.isfinite(r2) else None, p))
    return spark.createDataFrame(out, "set long, groups int, pseudo_f double, pseudo_r2 double, p_value double")
