"""Multi-factor association, validation of typologies, property-based trees, and regressions on memberships.

What needs all distances of a pair table together runs in one task, for a bounded number of rows, as in
:mod:`clustering`; the rest is grouped sums.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.functions import spells as S

from . import clustering as C
from . import discrepancy as A
from .medoids import MedoidSearch, _to
from .mismatches import Mismatches
from .sequences import SequenceFrame
from .tables import reads_pairs_often, stored


def _cell_sums(pairs: DataFrame | Mismatches, rows: DataFrame, factors: Sequence[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The combinations of factors' levels (a list for each factor), their weights, and the sums of w_i w_j d between them, in both directions.

    One pass; the driver gets a row per two combinations.
    """
    cell = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in factors]))
    tagged = rows.select("id", F.col("weight").cast("double").alias("weight"), cell.alias("cell"))
    weights = {r.cell: r.w for r in tagged.groupBy("cell").agg(F.sum("weight").alias("w")).collect()}  # a row per combination
    if isinstance(pairs, Mismatches):
        found = [(u, v, s) for _, _, u, v, s in pairs.cells(tagged.withColumn("node", F.lit(0)), ["cell"])]
    else:
        a, b = tagged.select(F.col("id").alias("i"), F.col("cell").alias("ci"), F.col("weight").alias("wi")), tagged.select(F.col("id").alias("j"), F.col("cell").alias("cj"), F.col("weight").alias("wj"))
        sums = pairs.join(a, "i").join(b, "j").groupBy("ci", "cj").agg(F.sum(F.col("wi") * F.col("wj") * F.col("d")).alias("s"))
        found = [(r.ci, r.cj, r.s) for r in sums.collect()]
    names = sorted(weights)
    at = {name: k for k, name in enumerate(names)}
    between = np.zeros((len(names), len(names)))
    for u, v, s in found:
        between[at[u], at[v]] += s
        between[at[v], at[u]] += s
    return [list(c) for c in zip(*map(json.loads, names), strict=True)], np.array([weights[name] for name in names]), between


def _design(columns: Sequence[Sequence[str | None]]) -> np.ndarray:
    """A constant and dummies of all levels but the first."""
    n = len(columns[0]) if columns else 0
    parts = [np.ones((n, 1))]
    for values in columns:
        levels = sorted({str(v) for v in values})
        parts.append(np.array([[float(str(v) == x) for x in levels[1:]] for v in values]).reshape(n, len(levels) - 1))
    return np.concatenate(parts, axis=1)


def _gower(between: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mean doubly centred distances between combinations, from the weighted sums between them."""
    d = np.divide(between, w[:, None] * w[None], out=np.zeros_like(between), where=(w[:, None] > 0) & (w[None] > 0))
    total = w.sum()
    m = d @ w / total
    return -0.5 * (d - m[:, None] - m[None] + (w @ m) / total)


def _explained(g: np.ndarray, x: np.ndarray, w: np.ndarray) -> float:
    """Trace of the weighted projection of the centred matrix on the design's columns."""
    more = max(0, x.shape[1] - len(x))  # columns that depend on others need rows to be told from them
    x, w, g = np.pad(x, ((0, more), (0, 0))), np.pad(w, (0, more)), np.pad(g, (0, more))
    s = np.sqrt(w)
    q, r = np.linalg.qr(x * s[:, None])
    q = q[:, np.abs(np.diag(r)) > 1e-9]
    return float(np.trace(q.T @ ((g * s[:, None] * s[None]) @ q)))


def multifactor_association(pairs: DataFrame | Mismatches, rows: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(term, pseudo_f, pseudo_r2): each factor over all the others, and the total; ``rows``: (id, weight, factors...).

    What a design explains depends on sums of distances between the combinations of levels alone.
    """
    columns, w, between = _cell_sums(pairs, rows, factors)
    g = _gower(between, w)
    total = float(between.sum() / (2 * w.sum())) if w.sum() else 0.0
    whole = _design(columns)
    all_ = _explained(g, whole, w)
    rest_df = w.sum() - np.linalg.matrix_rank(whole)
    found = []
    for k, name in enumerate([*factors, "total"]):
        less = _design([c for i, c in enumerate(columns) if i != k]) if name != "total" and len(columns) > 1 else np.ones((len(w), 1))
        gained = all_ - _explained(g, less, w)
        df = np.linalg.matrix_rank(whole) - np.linalg.matrix_rank(less)
        found.append((name, float((gained / df) / ((total - all_) / rest_df)) if df and total > all_ else 0.0, float(gained / total) if total else 0.0))
    return rows.sparkSession.createDataFrame(found, "term string, pseudo_f double, pseudo_r2 double")


@reads_pairs_often
def individual_indicators(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, marginality, gain): a row's distance to its group's centre, and by how much it is nearer than to that of all; ``rows``: (id, weight, group)."""
    own = A.distances_to_center(pairs, rows).select("id", F.col("dc").alias("marginality"))
    whole = A.distances_to_center(pairs, rows.select("id", "weight", F.lit(1).alias("group"))).select("id", "dc")
    return own.join(whole, "id").select("id", "marginality", (F.col("dc") - F.col("marginality")).alias("gain"))


def cluster_association(pairs: DataFrame, labels: DataFrame, covariate: str) -> DataFrame:
    """(unaccounted, remaining, cluster_r2, covariate_r2): how much of a covariate's association a typology leaves; ``labels``: (id, weight, cluster, covariate).

    ``remaining`` is the covariate's share over the clusters', ``unaccounted`` that over what clusters leave.
    """
    alone = multifactor_association(pairs, labels, [covariate]).where(F.col("term") == covariate).select(F.col("pseudo_r2").alias("covariate_r2"))
    both = multifactor_association(pairs, labels, ["cluster", covariate])
    wide = both.agg(*[F.max(F.when(F.col("term") == t, F.col("pseudo_r2"))).alias(n) for t, n in (("cluster", "cluster_over"), (covariate, "remaining"), ("total", "total"))])
    one = wide.join(alone, how="cross")  # a row each
    return one.select((F.col("remaining") / F.nullif(F.col("total") - F.col("cluster_over"), F.lit(0.0))).alias("unaccounted"), "remaining", (F.col("total") - F.col("remaining")).alias("cluster_r2"), "covariate_r2")


def merge_groups(pairs: DataFrame | Mismatches, rows: DataFrame, k: int) -> DataFrame:
    """(group, merged): groups joined two by two, each time those whose union adds least to the sum of squares, until k are left.

    Sums between groups are one pass, of which :class:`Mismatches` need no pair table; the merging is over groups.
    """
    if isinstance(pairs, Mismatches):
        found = pairs.cells(rows.select("id", "weight", F.col("group").cast("string").alias("group"), F.lit(0).alias("node")), ["group"])
        cross = {(u, v): s for _, _, u, v, s in found}
    else:
        a, b = rows.select(F.col("id").alias("i"), F.col("group").cast("string").alias("gi"), F.col("weight").alias("wi")), rows.select(F.col("id").alias("j"), F.col("group").cast("string").alias("gj"), F.col("weight").alias("wj"))
        cross = {(r.u, r.v): r.s for r in pairs.join(a, "i").join(b, "j").groupBy(F.least("gi", "gj").alias("u"), F.greatest("gi", "gj").alias("v")).agg(F.sum(F.col("wi") * F.col("wj") * F.col("d")).alias("s")).collect()}
    weight = {r.g: r.w for r in rows.groupBy(F.col("group").cast("string").alias("g")).agg(F.sum("weight").alias("w")).collect()}  # a row per group
    sets = {g: {g} for g in weight}

    def between(x: str, y: str) -> float:
        return sum(cross.get((min(p, q), max(p, q)), 0.0) for p in sets[x] for q in sets[y])

    def inner(x: str) -> float:
        return sum(cross.get((p, q), 0.0) for p in sets[x] for q in sets[x] if p <= q)

    while len(sets) > max(1, k):
        names = sorted(sets)
        size = {n: sum(weight[g] for g in sets[n]) for n in names}
        cost, x, y = min(((inner(x) + inner(y) + between(x, y)) / (size[x] + size[y]) - inner(x) / size[x] - inner(y) / size[y], x, y) for i, x in enumerate(names) for y in names[i + 1 :])
        del cost
        sets[x] |= sets.pop(y)
    return rows.sparkSession.createDataFrame(sorted((g, name) for name, held in sets.items() for g in held), "group string, merged string")


def bootstrap_range(pairs: DataFrame, rows: DataFrame, ks: Sequence[int], replicates: int = 20, seed: int = 1, most: int = 2_000) -> DataFrame:
    """(replicate, k, asw, r2) of PAM under resampled weights: replicates are tasks, each with its own copy of the matrix, for ``most`` rows.

    Over :class:`Mismatches` there is no matrix and no limit.
    """
    if isinstance(pairs, Mismatches):
        return _bootstrap_panel(pairs, rows, ks, replicates, seed)
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for replicates of a matrix of {most}")
    spread = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    tagged = pairs.select(spread, F.col("i").alias("a"), F.col("j").alias("b"), F.col("d").alias("x")).unionByName(rows.select(spread, F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("weight").cast("double").alias("x")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = pa.compute.is_null(table.column("b"))
        nodes, links = table.filter(own).sort_by("a"), table.filter(pa.compute.invert(own))
        ids, w = nodes.column("a").to_numpy(), nodes.column("x").to_numpy()
        d = np.zeros((len(ids), len(ids)))
        i, j = np.searchsorted(ids, links.column("a").to_numpy()), np.searchsorted(ids, links.column("b").to_numpy())
        d[i, j] = d[j, i] = links.column("x").to_numpy()
        rng = np.random.default_rng([seed, key[0].as_py()])
        drawn = rng.multinomial(max(1, round(w.sum())), w / w.sum()).astype(float)
        out: dict[str, list] = {"replicate": [], "k": [], "asw": [], "r2": []}
        total = drawn @ d @ drawn / 2 / drawn.sum()
        for k in ks:
            at = d[:, C.partition_medoids(d, drawn + 1e-9, k)].argmin(axis=1)
            mass = np.array([drawn[at == c].sum() for c in range(k)])
            to = np.stack([d[:, at == c] @ drawn[at == c] for c in range(k)], axis=1)
            inner = to[np.arange(len(ids)), at] / np.maximum(mass[at], 1e-9)
            means = to / np.maximum(mass, 1e-9)
            means[:, mass <= 0] = np.inf
            means[np.arange(len(ids)), at] = np.inf
            other = means.min(axis=1)
            width = np.where(np.isfinite(other), (other - inner) / np.maximum(np.maximum(other, inner), 1e-12), 0.0)
            ss = sum(to[at == c, c] @ drawn[at == c] / 2 / mass[c] for c in range(k) if mass[c] > 0)
            for name, value in (("replicate", key[0].as_py()), ("k", k), ("asw", float(drawn @ width / drawn.sum())), ("r2", float(1 - ss / total) if total else 0.0)):
                out[name].append(value)
        return pa.table({"replicate": pa.array(out["replicate"], pa.int32()), "k": pa.array(out["k"], pa.int32()), "asw": pa.array(out["asw"]), "r2": pa.array(out["r2"])})

    return tagged.groupBy("replicate").applyInArrow(run, "replicate int, k int, asw double, r2 double")


def _draws(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(id, replicate, w): resampled weights of replicates from 1, each drawn in a task that has ids and weights alone."""
    spread = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        nodes = table.sort_by("id")
        w = nodes.column("weight").to_numpy()
        drawn = np.random.default_rng([seed, key[0].as_py()]).multinomial(max(1, round(w.sum())), w / w.sum()).astype(float)
        return pa.table({"id": nodes.column("id"), "replicate": nodes.column("replicate"), "w": pa.array(drawn)})

    return rows.select(F.col("id").cast("long").alias("id"), F.col("weight").cast("double").alias("weight"), spread).groupBy("replicate").applyInArrow(draw, "id long, replicate int, w double")


def _by_replicate(each: DataFrame) -> DataFrame:
    """(id, w): the weights of (id, replicate, w) as an array in order of replicates."""
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "w"))), lambda x: x["w"]).alias("w"))


def _bootstrap_panel(gaps: Mismatches, rows: DataFrame, ks: Sequence[int], replicates: int, seed: int) -> DataFrame:
    """:func:`bootstrap_range` with the same draws, for which a task has ids and weights alone; all replicates are searched together."""
    search = MedoidSearch(gaps, _by_replicate(_draws(rows, replicates, seed)), 1e-9)
    problems = [(at, k, m) for (at, k), m in search.partition(list(ks), range(replicates)).items()]
    n_of = [len(m) for *_, m in problems]
    starts = np.r_[0, np.cumsum(n_of)]

    def shares(codes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weights by cluster of each problem, then those of each replicate."""
        own = [w[:, at][:, None] * (_to(codes, m).argmin(axis=1)[:, None] == np.arange(len(m))) for at, _, m in problems]
        return np.concatenate([*own, w], axis=1)

    profiles = search.profiles(shares, int(starts[-1]) + replicates)
    mass = profiles.sum(axis=1) / search.length
    totals = search.totals(profiles)

    def indices(codes: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sums of silhouettes, of distances within clusters over twice their weight, and of all distances."""
        all_, out = totals(codes), []
        for p, (at, _, m) in enumerate(problems):
            to, size = all_[:, starts[p] : starts[p + 1]], mass[starts[p] : starts[p + 1]]
            c, row = _to(codes, m).argmin(axis=1), np.arange(len(codes))
            inner = to[row, c] / np.maximum(size[c], 1e-9)
            means = to / np.maximum(size, 1e-9)
            means[:, size <= 0] = np.inf
            means[row, c] = np.inf
            other = means.min(axis=1)
            finite = np.isfinite(other)
            width = np.zeros(len(codes))
            width[finite] = (other - inner)[finite] / np.maximum(np.maximum(other, inner), 1e-12)[finite]
            own = np.divide(to[row, c], 2 * size[c], out=np.zeros(len(codes)), where=size[c] > 0)
            out += [w[:, at] @ width, w[:, at] @ own, w[:, at] @ all_[:, starts[-1] + at]]
        return np.array(out)

    found = search.sums(indices).reshape(len(problems), 3)
    rows_ = []
    for (at, k, _), (width, ss, twice) in zip(problems, found, strict=True):
        drawn = mass[starts[-1] + at]
        total = twice / 2 / drawn
        rows_.append((at + 1, k, float(width / drawn), float(1 - ss / total) if total else 0.0))
    return rows.sparkSession.createDataFrame(rows_, "replicate int, k int, asw double, r2 double")


def properties(frame: SequenceFrame, bands: int = 3) -> DataFrame:
    """(id, weight, time_<state>, spells_<state>, first, last, transitions): properties of sequences, numbers in up to ``bands`` bands of their range."""
    seq = F.col("seq")
    states = S.distinct_successive(seq)
    raw = frame.arrays.select("id", "weight", F.size(seq).alias("n"), S.state_counts(seq, frame.n_states).alias("t"), S.state_counts(states, frame.n_states).alias("k"), F.get(seq, F.lit(0)).alias("first"), F.element_at(seq, -1).alias("last"), F.size(states).alias("spells"))

    def band(value):
        return F.least(F.floor(value * bands), F.lit(bands - 1)).cast("int")

    times = [band(F.get("t", F.lit(i)) / F.col("n")).alias(f"time_{s}") for i, s in enumerate(frame.states)]
    counts = [F.least(F.get("k", F.lit(i)), F.lit(bands)).alias(f"spells_{s}") for i, s in enumerate(frame.states)]
    return raw.select("id", "weight", *times, *counts, "first", "last", band((F.col("spells") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("transitions"))


def property_tree(frame: SequenceFrame, pairs: DataFrame, min_size: int = 20, max_depth: int = 3) -> tuple[A.TreeNode, DataFrame]:
    """A tree of splits on sequences' own properties that lower their discrepancy most; ``pairs`` over the ids."""
    held = properties(frame)
    names = [c.replace(" ", "_") for c in held.columns]
    held = held.toDF(*names)
    return A.distance_tree(pairs, held, [c for c in names if c not in ("id", "weight")], min_size, max_depth)


def soft_classification(memberships: DataFrame, reference: int) -> DataFrame:
    """(id, u_2, ...): memberships as columns, without the reference's."""
    clusters = sorted(r[0] for r in memberships.select("cluster").distinct().collect())  # a row per cluster
    return memberships.groupBy("id").agg(*[F.max(F.when(F.col("cluster") == c, F.col("u"))).alias(f"u_{c}") for c in clusters if c != reference])


def pseudoclass_regression(memberships: DataFrame, outcome: DataFrame, draws: int = 20, seed: int = 1) -> DataFrame:
    """(cluster, mean, se): an outcome's mean by class, over seeded draws of classes by membership, pooled; ``outcome``: (id, y)."""
    from pyspark.sql import Window

    upto = F.sum("u").over(Window.partitionBy("id").orderBy("cluster"))
    bounds = memberships.withColumn("high", upto).withColumn("low", upto - F.col("u"))
    spread = bounds.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(F.lit(seed), "id", "draw"), F.lit(1 << 40)) / float(1 << 40)
    chosen = spread.where((u >= F.col("low")) & (u < F.col("high"))).join(outcome, "id")
    per = chosen.groupBy("draw", "cluster").agg(F.avg("y").alias("m"), (F.var_samp("y") / F.count("*")).alias("v"))
    pooled = per.groupBy("cluster").agg(F.avg("m").alias("mean"), F.avg("v").alias("within"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"))
    return pooled.select("cluster", "mean", F.sqrt(F.col("within") + (1 + 1 / F.lit(draws)) * F.col("between")).alias("se"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln gamma, for positive numbers."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 8).any():
        small = x < 8
        out[small] -= 1 / x[small]
        x = np.where(small, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def dirichlet_regression(rows: DataFrame, shares: Sequence[str], columns: Sequence[str], rounds: int = 60) -> DataFrame:
    """(share, term, coefficient): log-linear Dirichlet parameters of shares that sum to one.

    Gradient ascent with steps by component; each round adds up gradients over distinct rows of
    covariates, for which the sums of log shares are sufficient.
    """
    k, terms = len(shares), ["constant", *columns]
    total = sum((F.greatest(F.col(s), F.lit(1e-6)) for s in shares), F.lit(0.0))
    logs = [F.log(F.greatest(F.col(s), F.lit(1e-6)) / total) for s in shares]
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    held = rows.groupBy(x.alias("x")).agg(F.count("*").cast("double").alias("n"), *[F.sum(v).alias(f"l{i}") for i, v in enumerate(logs)])
    if held.count() > 100_000:
        raise ValueError("more than 100,000 distinct rows of covariates")
    data = held.collect()
    xs, n = np.array([r.x for r in data]), np.array([r.n for r in data])
    ls = np.array([[r[f"l{i}"] for i in range(k)] for r in data])
    beta, first, second = np.zeros((k, len(terms))), np.zeros((k, len(terms))), np.zeros((k, len(terms)))
    for step in range(1, rounds * 20 + 1):
        alpha = np.exp(np.clip(xs @ beta.T, -20, 20))
        grad = ((n[:, None] * (digamma(alpha.sum(axis=1))[:, None] - digamma(alpha)) + ls) * alpha).T @ xs / n.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        beta += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9) / math.sqrt(1 + step / 200)
    return rows.sparkSession.createDataFrame([(s, t, float(beta[i, j])) for i, s in enumerate(shares) for j, t in enumerate(terms)], "share string, term string, coefficient double")


def pseudoclass_ols(memberships: DataFrame, rows: DataFrame, outcome: str, columns: Sequence[str], draws: int = 20, seed: int = 1) -> DataFrame:
    """(term, coefficient, se): least squares of an outcome on class and covariates, over seeded draws of classes by membership, pooled.

    The first class is the reference. Each draw's normal equations are sums, a row per draw; the pooled variance is the
    mean within draws plus (1 + 1 / draws) times that between them.
    """
    from pyspark.sql import Window

    clusters = sorted(r[0] for r in memberships.select("cluster").distinct().collect())  # a row per cluster
    upto = F.sum("u").over(Window.partitionBy("id").orderBy("cluster"))
    bounds = memberships.withColumn("high", upto).withColumn("low", upto - F.col("u"))
    u = F.pmod(F.xxhash64(F.lit(seed), "id", "draw"), F.lit(1 << 40)) / float(1 << 40)
    chosen = bounds.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).where((u >= F.col("low")) & (u < F.col("high"))).select("id", "draw", "cluster").join(rows, "id")
    terms = ["constant", *(f"cluster_{c}" for c in clusters[1:]), *columns]
    values = [F.lit(1.0), *((F.col("cluster") == c).cast("double") for c in clusters[1:]), *(F.col(c).cast("double") for c in columns)]
    p, y = len(terms), F.col(outcome).cast("double")
    sums = [F.sum(a * b).alias(f"x{i}_{j}") for i, a in enumerate(values) for j, b in enumerate(values) if j >= i] + [F.sum(a * y).alias(f"y{i}") for i, a in enumerate(values)] + [F.sum(y * y).alias("yy"), F.count("*").alias("n")]
    betas, variances = [], []
    for row in chosen.groupBy("draw").agg(*sums).orderBy("draw").collect():  # a row per draw
        xx = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        xy = np.array([row[f"y{i}"] for i in range(p)])
        inverse = np.linalg.pinv(xx)
        beta = inverse @ xy
        betas.append(beta)
        variances.append(np.diag(inverse) * max(0.0, row.yy - beta @ xy) / max(1, row.n - p))
    b, v = np.array(betas), np.array(variances)
    between = b.var(axis=0, ddof=1) if len(b) > 1 else np.zeros(p)
    se = np.sqrt(v.mean(axis=0) + (1 + 1 / len(b)) * between)
    return rows.sparkSession.createDataFrame([(t, float(m), float(s)) for t, m, s in zip(terms, b.mean(axis=0), se, strict=True)], "term string, coefficient double, se double")


def beta_regression(rows: DataFrame, share: str, columns: Sequence[str], rounds: int = 4_000) -> DataFrame:
    """(term, coefficient): a share in (0, 1) as beta distributed, its mean a logit of covariates, and the log of its precision.

    Sums of log share and log rest over distinct covariates are sufficient; the driver's ascent works on those.
    """
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    y = F.least(F.greatest(F.col(share).cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    held = rows.groupBy(x.alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(F.log(y)).alias("a"), F.sum(F.log(1 - y)).alias("b"))
    if held.count() > 100_000:
        raise ValueError("more than 100,000 distinct rows of covariates")
    data = held.collect()
    xs, n, a, b = np.array([r.x for r in data]), np.array([r.n for r in data]), np.array([r.a for r in data]), np.array([r.b for r in data])
    beta = np.zeros(xs.shape[1] + 1)
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    for step in range(1, rounds + 1):
        mu = 1 / (1 + np.exp(-np.clip(xs @ beta[:-1], -20, 20)))
        phi = float(np.exp(np.clip(beta[-1], -10, 15)))
        p, q = digamma(mu * phi), digamma((1 - mu) * phi)
        g = (((a - n * p) - (b - n * q)) * phi * mu * (1 - mu)) @ xs
        h = (n * digamma(np.full(len(n), phi)) + mu * (a - n * p) + (1 - mu) * (b - n * q)).sum() * phi
        grad = np.append(g, h) / n.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        beta += 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9) / math.sqrt(1 + step / 100)
    return rows.sparkSession.createDataFrame([(t, float(v)) for t, v in zip(["constant", *columns, "log_precision"], beta, strict=True)], "term string, coefficient double")


def _logit_effect(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Mean change of a weighted logistic regression's probability with its one covariate, by Newton steps with a slight pull to zero."""
    z, beta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z.T * (w * p * (1 - p))) @ z + 1e-6 * np.eye(2), z.T @ (w * (y - p)) - 1e-6 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
    if set(np.unique(x)) <= {0.0, 1.0}:
        ends = 1 / (1 + np.exp(-np.array([beta[0], beta[0] + beta[1]])))
        return float(ends[1] - ends[0])
    return float((w * p * (1 - p)).sum() / w.sum() * beta[1])


def typology_effects(pairs: DataFrame | Mismatches, rows: DataFrame, covariate: str, k: int, replicates: int = 20, seed: int = 1, most: int = 2_000) -> DataFrame:
    """(cluster, effect, mean, sd): a covariate's average marginal effect on being in a cluster, in the typology and over bootstrapped ones.

    Rows and weights are resampled, clustered by PAM anew and regressed; a row's effect is that of the cluster it is in, and a
    cluster's that of its rows' means. Each replicate is a task with a copy of the matrix, so up to ``most`` rows. Over
    :class:`Mismatches` there is no matrix and no limit.
    """
    if isinstance(pairs, Mismatches):
        return _effects(_panel_effects(pairs, rows, covariate, k, replicates, seed))
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for replicates of a matrix of {most}")
    spread = F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate")
    own = rows.select(spread, F.col("id").cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("weight").cast("double").alias("x"), F.col(covariate).cast("double").alias("c"))
    tagged = pairs.select(spread, F.col("i").alias("a"), F.col("j").alias("b"), F.col("d").alias("x"), F.lit(None).cast("double").alias("c")).unionByName(own)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        alone = pa.compute.is_null(table.column("b"))
        nodes, links = table.filter(alone).sort_by("a"), table.filter(pa.compute.invert(alone))
        ids, w, c = nodes.column("a").to_numpy(), nodes.column("x").to_numpy(), nodes.column("c").to_numpy()
        d = np.zeros((len(ids), len(ids)))
        i, j = np.searchsorted(ids, links.column("a").to_numpy()), np.searchsorted(ids, links.column("b").to_numpy())
        d[i, j] = d[j, i] = links.column("x").to_numpy()
        if key[0].as_py():
            w = np.random.default_rng([seed, key[0].as_py()]).multinomial(max(1, round(w.sum())), w / w.sum()).astype(float)
        at = d[:, C.partition_medoids(d, w + 1e-9, k)].argmin(axis=1)
        effects = np.array([_logit_effect(c, (at == g).astype(float), w) if (w[at == g] > 0).any() else 0.0 for g in range(k)])
        return pa.table({"replicate": pa.array(np.full(len(ids), key[0].as_py()), pa.int32()), "id": pa.array(ids), "cluster": pa.array(at + 1, pa.int32()), "effect": pa.array(effects[at])})

    return _effects(tagged.groupBy("replicate").applyInArrow(run, "replicate int, id long, cluster int, effect double"))


def _panel_effects(gaps: Mismatches, rows: DataFrame, covariate: str, k: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, id, cluster, effect) of :func:`typology_effects` with the same draws; replicate 0 are the data.

    All replicates are searched together. A regression needs the weights by cluster and value of the covariate alone.
    """
    drawn = _draws(rows, replicates, seed)
    own = rows.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("replicate"), F.col("weight").cast("double").alias("w"))
    each = stored(own.unionByName(drawn))
    search = MedoidSearch(gaps, _by_replicate(each), 1e-9)
    held = search.partition([k], range(replicates + 1))
    medoids = [held[r, k] for r in range(replicates + 1)]

    def nearest(ids: np.ndarray, codes: np.ndarray) -> dict:
        at = [_to(codes, m).argmin(axis=1) + 1 for m in medoids]
        return {"id": np.tile(ids, len(at)), "replicate": np.repeat(np.arange(len(at), dtype=np.int32), len(ids)), "cluster": np.concatenate(at).astype(np.int32)}

    labels = stored(search.rows(nearest, "id long, replicate int, cluster int"))
    value = rows.select(F.col("id").cast("long").alias("id"), F.col(covariate).cast("double").alias("c"))
    cells = labels.join(each, ["id", "replicate"]).join(value, "id").groupBy("replicate", "cluster", "c").agg(F.sum("w").alias("w"))

    def regress(table: pa.Table) -> pa.Table:
        cluster, c, w = (table.column(name).to_numpy() for name in ("cluster", "c", "w"))
        found = [_logit_effect(c, (cluster == g).astype(float), w) if (w[cluster == g] > 0).any() else 0.0 for g in range(1, k + 1)]
        return pa.table({"replicate": pa.array(np.full(k, table.column("replicate")[0].as_py()), pa.int32()), "cluster": pa.array(range(1, k + 1), pa.int32()), "effect": pa.array(found, pa.float64())})

    effects = cells.groupBy("replicate").applyInArrow(regress, "replicate int, cluster int, effect double")
    return labels.join(effects, ["replicate", "cluster"]).select("replicate", "id", "cluster", "effect")


def _effects(each: DataFrame) -> DataFrame:
    """(cluster, effect, mean, sd) of (replicate, id, cluster, effect)."""
    each = stored(each)
    seen = each.where("replicate = 0").select("id", "cluster", F.col("effect").alias("own"))
    per = each.where("replicate > 0").join(seen.select("id", F.col("cluster").alias("c0")), "id").groupBy("replicate", "c0").agg(F.avg("effect").alias("e"))
    drawn = per.groupBy(F.col("c0").alias("cluster")).agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"))
    return seen.groupBy("cluster").agg(F.first("own").alias("effect")).join(drawn, "cluster", "left")
