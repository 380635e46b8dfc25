"""Discrepancy analysis: pseudo analysis of variance on a pair table, with permutation tests, trees and group comparison.

Sums of squares come from grouped sums over the pair table: a group's is the weighted sum of its
pairs' distances over its weight. Permutations shuffle labels, never pairs: replicate labels are a
seeded hash order, and all replicates' sums are one grouped pass. Of Hamming distances, sums come
from ``mismatches.Mismatches`` without pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.functions.special import chi_square_tail

from .distances import both_ways
from .mismatches import Mismatches
from .tables import reads_pairs_often, shuffles, stored


def _weighted(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with both ends' weights and groups; ``rows``: (id, weight[, group])."""
    a = rows.select(F.col("id").alias("i"), *[F.col(c).alias(f"{c}_i") for c in rows.columns if c != "id"])
    b = rows.select(F.col("id").alias("j"), *[F.col(c).alias(f"{c}_j") for c in rows.columns if c != "id"])
    return pairs.join(a, "i").join(b, "j")


def overall_discrepancy(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(n, weight, ss, discrepancy): sum of w_i w_j d over the pairs, over W, and over W squared."""
    total = rows.agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    if isinstance(pairs, Mismatches):
        ss = pairs.within(rows.select("id", "weight", F.lit(1).alias("group"))).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))
    else:
        ss = _weighted(pairs, rows.select("id", "weight")).agg(F.coalesce(F.sum(F.col("weight_i") * F.col("weight_j") * F.col("d")), F.lit(0.0)).alias("s"))
    return total.join(F.broadcast(ss), how="cross").select("n", "weight", (F.col("s") / F.col("weight")).alias("ss"), (F.col("s") / (F.col("weight") * F.col("weight"))).alias("discrepancy"))


def group_discrepancy(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(group, n, weight, ss, discrepancy); ``rows``: (id, weight, group)."""
    if isinstance(pairs, Mismatches):
        joined = pairs.within(rows)
    else:
        joined = _weighted(pairs, rows).where("group_i = group_j").groupBy(F.col("group_i").alias("group")).agg(F.sum(F.col("weight_i") * F.col("weight_j") * F.col("d")).alias("s"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    s = F.coalesce("s", F.lit(0.0))
    return sizes.join(joined, "group", "left").select("group", "n", "weight", (s / F.col("weight")).alias("ss"), (s / (F.col("weight") * F.col("weight"))).alias("discrepancy"))


@reads_pairs_often
def association(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: n, groups, ss_total, ss_within, ss_explained, pseudo_f, pseudo_r2, levene, for ``rows`` (id, weight, group)."""
    whole = overall_discrepancy(pairs, rows)
    groups = group_discrepancy(pairs, rows)
    inner = groups.agg(F.count("*").alias("groups"), F.sum("ss").alias("ss_within"))
    centred = distances_to_center(pairs, rows)
    levene = _levene(centred)
    out = whole.join(F.broadcast(inner), how="cross").join(F.broadcast(levene), how="cross")
    k, n = F.col("groups"), F.col("weight")
    explained = F.col("ss") - F.col("ss_within")
    f = F.when((k > 1) & (n > k) & (F.col("ss_within") > 0), (explained / (k - 1)) / (F.col("ss_within") / (n - k)))
    return out.select("n", "groups", F.col("ss").alias("ss_total"), "ss_within", explained.alias("ss_explained"), f.alias("pseudo_f"), (explained / F.nullif("ss", F.lit(0.0))).alias("pseudo_r2"), "levene")


def distances_to_center(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, group, weight, dc): each row's distance to its group's centre, mean distance less half the group's mean."""
    if isinstance(pairs, Mismatches):
        sums = pairs.totals(rows).select(F.col("id").alias("i"), F.col("total").alias("s"))
    else:
        sides = both_ways(pairs)
        a, b = rows.select(F.col("id").alias("i"), F.col("group").alias("gi")), rows.select(F.col("id").alias("j"), F.col("group").alias("gj"), F.col("weight").alias("wj"))
        sums = sides.join(a, "i").join(b, "j").where("gi = gj").groupBy("i").agg(F.sum(F.col("wj") * F.col("d")).alias("s"))
    groups = group_discrepancy(pairs, rows).select("group", F.col("weight").alias("W"), "discrepancy")
    joined = rows.join(sums.select(F.col("i").alias("id"), "s"), "id", "left").join(groups, "group")
    return joined.select("id", "group", "weight", (F.coalesce("s", F.lit(0.0)) / F.col("W") - F.col("discrepancy")).alias("dc"))


def _levene(centred: DataFrame) -> DataFrame:
    per = centred.groupBy("group").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("dc")).alias("s"), F.sum(F.col("weight") * F.col("dc") * F.col("dc")).alias("q"))
    total = per.agg(F.sum("w").alias("W"), F.sum("s").alias("S"), F.sum(F.col("s") * F.col("s") / F.col("w")).alias("B"), F.sum("q").alias("Q"), F.count("*").alias("k"))
    between, within = F.col("B") - F.col("S") * F.col("S") / F.col("W"), F.col("Q") - F.col("B")
    return total.select(F.when((F.col("k") > 1) & (within > 1e-12), (between / (F.col("k") - 1)) / (within / (F.col("W") - F.col("k")))).alias("levene"))


STATISTICS = ("pseudo_f", "pseudo_fbf", "pseudo_r2", "bartlett", "levene")
#: Ids times replicates whose labels travel with the tasks at once; more replicates take more passes.
MOST_LABELS = 4_000_000


def _statistics(np, w, ss, z, total_w, total_ss) -> dict:
    """The five statistics from (replicates, groups) arrays of weights, sums of squares and spreads of centre distances."""
    k = (w > 0).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        within = ss.sum(axis=1)
        explained = total_ss - within
        v = np.where(w > 0, ss / w, 0.0)
        f = explained / (k - 1) / (within / (total_w - k))
        fbf = explained / ((1 - w / total_w) * v).sum(axis=1)
        several = w > 1
        pooled = np.where(several, (w - 1) * v, 0.0).sum(axis=1) / (total_w - k)
        logs = np.where(several, (w - 1) * np.log(v), 0.0).sum(axis=1)
        least = 1 + (np.where(several, 1 / (w - 1), 0.0).sum(axis=1) - 1 / (total_w - k)) / (3 * (k - 1))
        bartlett = ((total_w - k) * np.log(pooled) - logs) / least
        spread, z_all = z["within"], z["total"]
        levene = (z_all - spread) / (k - 1) / (spread / (total_w - k))
    return dict(zip(STATISTICS, (f, fbf, explained / total_ss, bartlett, levene), strict=True))


@reads_pairs_often
def association_test(pairs: DataFrame, rows: DataFrame, replicates: int = 99, seed: int = 1) -> DataFrame:
    """(statistic, value, p_value, replicates) of the five statistics; ``rows``: (id, weight, group).

    Groups are dealt out anew in ``replicates`` seeded orders, weights stay with their rows. A p-value is the share of
    replicates, the observed order included, with a value as large. All orders of a pass are summed in one narrow pass
    over the pair table, in which a task holds a number per id and order, and gives a row per id.
    """
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession
    held = rows.select("id", F.col("weight").cast("double").alias("weight"), F.col("group").cast("string").alias("group")).orderBy(F.xxhash64("id"), "id").toArrow()  # a row per id of a quadratic table
    ids, weight = held.column("id").to_numpy(), held.column("weight").to_numpy()
    names, group = np.unique(np.array(["" if g is None else g for g in held.column("group").to_pylist()]), return_inverse=True)
    n, k = len(ids), len(names)
    if not n:
        return spark.createDataFrame([], "statistic string, value double, p_value double, replicates int")
    place = np.argsort(ids, kind="stable")
    known = ids[place]
    orders = [(1, 0), *shuffles(n, replicates, seed)]
    step = max(1, MOST_LABELS // n)
    found: dict[str, list] = {s: [] for s in STATISTICS}
    for at in range(0, len(orders), step):
        labels = np.stack([group[(a * np.arange(n) + b) % n] for a, b in orders[at : at + step]], axis=1).astype(np.int32)  # (n, orders)
        width = labels.shape[1]

        def sums(batches, labels=labels, width=width):
            out = np.zeros((n, width))
            for batch in batches:
                i, j = (place[np.searchsorted(known, batch.column(c).to_numpy())] for c in ("i", "j"))
                d = batch.column("d").to_numpy()
                same = labels[i] == labels[j]
                np.add.at(out, i, same * (weight[j] * d)[:, None])
                np.add.at(out, j, same * (weight[i] * d)[:, None])
            hit = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(list(out[hit]), pa.list_(pa.float64()))], names=["at", "s"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.asarray(x) for x in table.column("s").to_pylist()], axis=0)
            return pa.table({"at": pa.array([table.column("at")[0].as_py()]), "s": pa.array([total], pa.list_(pa.float64()))})

        inside = pairs.join(rows.select(F.col("id").alias("i")), "i", "left_semi").join(rows.select(F.col("id").alias("j")), "j", "left_semi").select("i", "j", "d")
        parts = inside.mapInArrow(sums, "at long, s array<double>").groupBy("at").applyInArrow(add, "at long, s array<double>").toArrow()
        to = np.zeros((n, width))
        to[parts.column("at").to_numpy()] = np.stack([np.asarray(x) for x in parts.column("s").to_pylist()]) if parts.num_rows else 0.0
        if at == 0:
            total_w = weight.sum()
            total_ss = pairs.join(rows.select(F.col("id").alias("i"), F.col("weight").alias("wi")), "i").join(rows.select(F.col("id").alias("j"), F.col("weight").alias("wj")), "j").agg(F.sum(F.col("wi") * F.col("wj") * F.col("d"))).first()[0] or 0.0
            total_ss /= total_w
        w, ss, z = np.zeros((width, k)), np.zeros((width, k)), {"within": np.zeros(width), "total": np.zeros(width)}
        for r in range(width):
            w[r] = np.bincount(labels[:, r], weights=weight, minlength=k)
            ss[r] = np.bincount(labels[:, r], weights=weight * to[:, r], minlength=k) / 2 / np.maximum(w[r], 1e-300)
            centre = to[:, r] / w[r][labels[:, r]] - (ss[r] / np.maximum(w[r], 1e-300))[labels[:, r]]
            mean = np.bincount(labels[:, r], weights=weight * centre, minlength=k) / np.maximum(w[r], 1e-300)
            z["within"][r] = (weight * (centre - mean[labels[:, r]]) ** 2).sum()
            z["total"][r] = (weight * (centre - (weight * centre).sum() / total_w) ** 2).sum()
        for name, values in _statistics(np, w, ss, z, total_w, total_ss).items():
            found[name].extend(values.tolist())
    out = []
    for name in STATISTICS:
        values = np.array(found[name])
        seen = values[0]
        out.append((name, float(seen) if np.isfinite(seen) else None, float((values >= seen - 1e-12).mean()) if np.isfinite(seen) else None, replicates))
    return spark.createDataFrame(out, "statistic string, value double, p_value double, replicates int")


@reads_pairs_often
def permutation_test(pairs: DataFrame, rows: DataFrame, replicates: int = 99, seed: int = 1) -> DataFrame:
    """(pseudo_f, pseudo_r2, p_value, replicates): the share of replicates, the observed included, with an F as large."""
    test = association_test(pairs, rows, replicates, seed)
    value = lambda name, column="value": F.max(F.when(F.col("statistic") == name, F.col(column)))
    return test.agg(value("pseudo_f").alias("pseudo_f"), value("pseudo_r2").alias("pseudo_r2"), value("pseudo_f", "p_value").alias("p_value"), F.lit(replicates).cast("long").alias("replicates"))


@reads_pairs_often
def group_difference(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(n, lrt, p_value, bic, bayes_factor) of two groups against one: n (ln(ss/n) - ln((ss1 + ss2)/n)), chi-square on one degree."""
    n_groups = rows.select("group").distinct().count()
    if n_groups != 2:
        raise ValueError("two groups are compared")
    one = association(pairs, rows).first()
    spark = rows.sparkSession
    lrt = one.n * (math.log(one.ss_total / one.n) - math.log(one.ss_within / one.n)) if one.ss_within and one.ss_total else 0.0
    bic = lrt - math.log(one.n)
    return spark.createDataFrame([(int(one.n), lrt, chi_square_tail(lrt, 1), bic, math.exp(min(700.0, bic / 2)))], "n long, lrt double, p_value double, bic double, bayes_factor double")


def compare_by_position(frame, labels: DataFrame, before: int = 0, after: int = 1) -> DataFrame:
    """(pos, pseudo_f, pseudo_r2): association of groups with Hamming distances in a window around each position.

    The mismatches of all pairs at a position follow from the numbers of rows by state, so no pairs are made. A window
    counts the rows that have its position.
    """
    rows = frame.long.join(labels, "id").select("id", "pos", "code", "group")
    shifted = rows.select("id", "code", "group", F.explode(F.transform(F.sequence(F.lit(-after), F.lit(before)), lambda o: F.col("pos") + o)).alias("pos"), F.col("pos").alias("at"))
    held = shifted.join(rows.select("id", "pos"), ["id", "pos"])  # those of rows that have the window's position
    counts = held.groupBy("pos", "at", "group", "code").agg(F.count("*").alias("n"))
    gap = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
    total = counts.groupBy("pos", "at", "code").agg(F.sum("n").alias("n")).groupBy("pos", "at").agg(gap.alias("s")).groupBy("pos").agg(F.sum("s").alias("s"))
    inner = counts.groupBy("pos", "at", "group").agg(gap.alias("s")).groupBy("pos", "group").agg(F.sum("s").alias("s"))
    sizes = rows.groupBy("pos", "group").agg(F.count("*").alias("n"))
    within = sizes.join(inner, ["pos", "group"], "left").groupBy("pos").agg(F.sum(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ss = F.col("s") / F.col("n")
    f = F.when((F.col("within") > 0) & (F.col("k") > 1), ((ss - F.col("within")) / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))))
    return within.join(total, "pos").select("pos", f.alias("pseudo_f"), (1 - F.col("within") / F.nullif(ss, F.lit(0.0))).alias("pseudo_r2"))


@dataclass
class TreeNode:
    """A node of a regression tree on distances; leaves have no split."""

    id: int
    depth: int
    n: float
    ss: float
    variable: str | None = None
    values: tuple = ()
    r2: float = 0.0
    p_value: float | None = None
    children: list[TreeNode] = field(default_factory=list)

    def leaves(self) -> list[TreeNode]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]

    def lines(self, indent: int = 0) -> list[str]:
        own = f"{'  ' * indent}node {self.id}: n={self.n:g} ss={self.ss:.4f}" + (f" split {self.variable} in {list(self.values)} r2={self.r2:.4f}" if self.variable else "")
        return [own, *(x for c in self.children for x in c.lines(indent + 1))]


def distance_tree(
    pairs: DataFrame, rows: DataFrame, predictors: list[str], min_size: int = 20, max_depth: int = 3, min_r2: float = 0.01,
    replicates: int = 0, max_p: float = 0.05, seed: int = 1, weights: str = "diss",
) -> tuple[TreeNode, DataFrame]:
    """A tree of binary splits, each a predictor's values in order of their mean distance to the node's centre; and (id, leaf).

    Each level is one grouped pass over the pairs within nodes, by predictor and pair of values: the
    driver gets sums per pair of values, not rows. With ``replicates`` a node is split if its best split
    has a p-value of ``max_p`` or less when its rows are dealt out anew; all open nodes of a level are
    tested in one pass (``permutations.set_tests``, which says what ``weights`` do).
    """
    members = stored(rows.select("id", "weight", *predictors)).withColumn("node", F.lit(1))
    root: TreeNode | None = None
    known: dict[int, TreeNode] = {}
    open_ = {1}
    for depth in range(max_depth + 1):
        sums = _cells(pairs, members.where(F.col("node").isin(*open_)), predictors)
        sizes = members.where(F.col("node").isin(*open_)).select("node", "weight", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).cast("string").alias("u")) for p in predictors])).alias("c")).groupBy("node", "c.p", "c.u").agg(F.sum("weight").alias("w")).collect()
        splits: dict[int, tuple] = {}
        for node in sorted(open_):
            weight = {(r.p, r.u): r.w for r in sizes if r.node == node}
            total_w = sum(w for (p, _), w in weight.items() if p == predictors[0])
            cross = {(p, u, v): x for at, p, u, v, x in sums if at == node}
            ss = sum(x for (p, _, _), x in cross.items() if p == predictors[0]) / total_w if total_w else 0.0
            held = known.setdefault(node, TreeNode(node, depth, total_w, ss))
            held.n, held.ss = total_w, ss
            root = root or held
            best = _best_split(predictors, weight, cross, total_w, ss, min_size) if depth < max_depth else None
            if best and best[0] >= min_r2:
                splits[node] = best
        if splits and replicates:
            splits = _tested(pairs, members, splits, known, replicates, max_p, seed + depth, weights)
        if not splits:
            break
        label = F.col("node")
        open_ = set()
        for node, (r2, variable, left) in splits.items():
            held = known[node]
            held.variable, held.values, held.r2 = variable, tuple(left), r2
            held.children = [known.setdefault(2 * node, TreeNode(2 * node, depth + 1, 0, 0)), known.setdefault(2 * node + 1, TreeNode(2 * node + 1, depth + 1, 0, 0))]
            label = F.when(F.col("node") == node, F.when(F.col(variable).cast("string").isin(*left), 2 * node).otherwise(2 * node + 1)).otherwise(label)
            open_ |= {2 * node, 2 * node + 1}
        members = members.withColumn("node", label)
    return root, members.select("id", F.col("node").alias("leaf"))


def _cells(pairs: DataFrame | Mismatches, members: DataFrame, predictors: list[str]) -> list[tuple]:
    """(node, p, u, v, sum of w_i w_j d) for each node, predictor p and two of its values, over the node's pairs that have them."""
    if isinstance(pairs, Mismatches):
        return pairs.cells(members, predictors)
    a = members.select(F.col("id").alias("i"), F.col("node"), F.col("weight").alias("wi"), *[F.col(p).cast("string").alias(f"{p}_i") for p in predictors])
    b = members.select(F.col("id").alias("j"), F.col("node").alias("node_j"), F.col("weight").alias("wj"), *[F.col(p).cast("string").alias(f"{p}_j") for p in predictors])
    inside = pairs.join(a, "i").join(b, "j").where(F.col("node") == F.col("node_j"))
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(f"{p}_i", f"{p}_j").alias("u"), F.greatest(f"{p}_i", f"{p}_j").alias("v")) for p in predictors]))
    return [tuple(r) for r in inside.select("node", (F.col("wi") * F.col("wj") * F.col("d")).alias("x"), cells.alias("c")).groupBy("node", "c.p", "c.u", "c.v").agg(F.sum("x").alias("x")).collect()]


def _tested(pairs: DataFrame, members: DataFrame, splits: dict[int, tuple], known: dict[int, TreeNode], replicates: int, max_p: float, seed: int, weights: str) -> dict[int, tuple]:
    """The splits that are significant; nodes learn their p-values."""
    from .permutations import set_tests

    side: Column = F.lit(None).cast("boolean")
    for node, (_, variable, left) in splits.items():
        side = F.when(F.col("node") == node, F.coalesce(F.col(variable).cast("string").isin(*left), F.lit(False))).otherwise(side)
    rows = members.where(F.col("node").isin(*splits)).select("id", "weight", F.col("node").alias("set"), side.alias("group"))
    for r in set_tests(pairs, rows, replicates, seed, weights).collect():  # a row per open node
        known[r["set"]].p_value = r.p_value
    return {node: split for node, split in splits.items() if known[node].p_value is not None and known[node].p_value <= max_p}


def _best_split(predictors: list[str], weight: dict, cross: dict, total_w: float, ss: float, min_size: int) -> tuple | None:
    best = None
    for p in predictors:
        values = sorted(u for (q, u) in weight if q == p)
        if len(values) < 2 or ss <= 0:
            continue

        def pair(u: str, v: str, p: str = p) -> float:
            return cross.get((p, min(u, v), max(u, v)), 0.0)

        numeric = all(_number(v) is not None for v in values)
        order = sorted(values, key=_number) if numeric else sorted(values, key=lambda u: (sum(pair(u, v) for v in values) / weight[(p, u)], u))
        for cut in range(1, len(order)):
            left, right = order[:cut], order[cut:]
            wl, wr = sum(weight[(p, u)] for u in left), sum(weight[(p, u)] for u in right)
            if wl < min_size or wr < min_size:
                continue
            inner = sum(sum(pair(u, v) for a, u in enumerate(side) for v in side[a:]) / w for side, w in ((left, wl), (right, wr)))
            r2 = 1 - inner / ss
            if best is None or r2 > best[0]:
                best = (r2, p, left)
    return best


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def tree_rules(root: TreeNode) -> list[tuple[int, str]]:
    """(leaf, rule) as SQL conditions."""
    out = []

    def walk(node: TreeNode, rule: list[str]) -> None:
        if not node.children:
            out.append((node.id, " AND ".join(rule) or "true"))
            return
        values = ", ".join("'" + str(v).replace("'", "''") + "'" for v in node.values)
        walk(node.children[0], [*rule, f"CAST({node.variable} AS STRING) IN ({values})"])
        walk(node.children[1], [*rule, f"CAST({node.variable} AS STRING) NOT IN ({values})"])

    walk(root, [])
    return out


def assign_leaves(rows: DataFrame, root: TreeNode) -> DataFrame:
    """``rows`` with ``leaf``, by the tree's rules."""
    leaf: Column = F.lit(None).cast("int")
    for node, rule in tree_rules(root):
        leaf = F.when(F.expr(rule), node).otherwise(leaf)
    return rows.withColumn("leaf", leaf)


@reads_pairs_often
def marginal_association(pairs: DataFrame, rows: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, pseudo_f, pseudo_r2, levene) of each factor alone; ``rows``: (id, weight, factors...)."""
    out = None
    for factor in factors:
        one = association(pairs, rows.select("id", "weight", F.col(factor).alias("group"))).select(F.lit(factor).alias("factor"), "pseudo_f", "pseudo_r2", "levene")
        out = one if out is None else out.unionByName(one)
    return out
