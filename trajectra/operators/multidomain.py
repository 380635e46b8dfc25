"""Several domains of the same ids: combined states, additive costs and distances, association, linked polyads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.functions import kernels as K
from trajectra.functions.special import chi_square_tail

from . import distances as D
from .clustering import silhouettes
from .mismatches import Mismatches, side_by_side
from .sequences import SequenceFrame
from .tables import numbered, stored


def _combined(domains: Sequence[SequenceFrame], separator: str) -> tuple[SequenceFrame, list[tuple[str, ...]]]:
    """The combined table and each of its states' parts; an error where two combinations get the same name."""
    rows = None
    for n, frame in enumerate(domains):
        one = frame.long.select("id", "pos", frame.state_of(F.col("code")).alias(f"s{n}"), *(["weight"] if n == 0 else []))
        rows = one if rows is None else rows.join(one, ["id", "pos"])
    parts = [f"s{n}" for n in range(len(domains))]
    named = rows.select("id", "pos", F.concat_ws(separator, *parts).alias("state"), "weight", *parts)
    found = sorted(tuple(r) for r in named.select("state", *parts).distinct().collect())  # the alphabets' product at most
    states = [r[0] for r in found]
    if len(set(states)) < len(states):
        raise ValueError(f"combined states' names repeat: no state may hold {separator!r}, choose another separator")
    from .sequences import build

    return build(named.drop(*parts), "id", "pos", "state", states, weight="weight"), [tuple(r[1:]) for r in found]


def combined(domains: Sequence[SequenceFrame], separator: str = "+") -> SequenceFrame:
    """One table whose states are the domains' states together; those that occur make the alphabet."""
    return _combined(domains, separator)[0]


def combined_states(domains: Sequence[SequenceFrame]) -> DataFrame:
    """(state, n, share): how the combined states occur."""
    frame = combined(domains)
    counts = frame.long.groupBy(frame.state_of(F.col("code")).alias("state")).agg(F.sum("weight").alias("n"))
    total = frame.long.agg(F.sum("weight").alias("total"))
    return counts.join(F.broadcast(total), how="cross").select("state", "n", (F.col("n") / F.col("total")).alias("share"))


def additive_costs(domains: Sequence[SequenceFrame], costs: Sequence[list[list[float]]], weights: Sequence[float] | None = None, link: str = "sum", separator: str = "+") -> tuple[SequenceFrame, list[list[float]]]:
    """The combined table and costs that add up the domains' costs, weighted; ``mean`` divides by the weights' sum."""
    weights = list(weights or [1.0] * len(domains))
    frame, parts = _combined(domains, separator)
    place = [{s: i for i, s in enumerate(d.states)} for d in domains]
    scale = sum(weights) if link == "mean" else 1.0
    table = [[sum(w * c[p[x[n]]][p[y[n]]] for n, (w, c, p) in enumerate(zip(weights, costs, place, strict=True))) / scale for y in parts] for x in parts]
    return frame, table


def additive_cost_distances(domains: Sequence[SequenceFrame], costs: Sequence[list[list[float]]], method: str = "OM", indel: float | None = None, weights: Sequence[float] | None = None, link: str = "sum", norm: str = "none") -> tuple[SequenceFrame, DataFrame]:
    """Distances of the combined sequences under additive costs."""
    frame, table = additive_costs(domains, costs, weights, link)
    return frame, D.pairwise(frame, method, costs=table, indel=indel, norm=norm)


def summed_distances(domains: Sequence[SequenceFrame], options: Sequence[dict], weights: Sequence[float] | None = None, link: str = "sum") -> DataFrame:
    """(i, j, d) over the rows' ids: the domains' distances, added with weights.

    Rows that agree in all domains are compared once: each distinct combination is a row of arrays,
    and all domains' kernels run on the same pair of blocks.
    """
    weights = list(weights or [1.0] * len(domains))
    scale = sum(weights) if link == "mean" else 1.0
    measures = [D.measure(f, **o) for f, o in zip(domains, options, strict=True)]
    rows = reduce(lambda a, b: a.join(b, "id"), [f.arrays.select("id", F.col("seq").alias(f"q{n}")) for n, f in enumerate(domains)])
    names = [f"q{n}" for n in range(len(domains))]
    unique = rows.groupBy(*names).agg(F.min("id").cast("long").alias("uid"))

    def prepare(rows: pa.Table) -> tuple:
        return rows.column("uid").to_numpy(), [m.block(rows.column(c).to_pylist()) for m, c in zip(measures, names, strict=True)]

    def compare(a: tuple, b: tuple, same: bool) -> pa.Table:
        total = sum(w * m.distances(x, y) for w, m, x, y in zip(weights, measures, a[1], b[1], strict=True)) / scale
        return D._links(a[0], b[0], total, same)

    return D.block_pairs(unique.select("uid", *names), compare, "i long, j long, d double", ordered=True, prepare=prepare)


def summed(domains: Sequence[SequenceFrame], options: Sequence[dict], weights: Sequence[float] | None = None, link: str = "sum") -> tuple[SequenceFrame, D.SummedMeasure]:
    """One table of the domains' sequences together, and the measure of their summed distances.

    ``clara`` and ``to_references`` take both, so that no pair table is made. Costs that depend on
    the data are those of each whole domain. Ids that a domain doesn't have are left out.
    """
    weights = [float(w) for w in weights or [1.0] * len(domains)]
    if len(options) != len(domains) or len(weights) != len(domains) or min(weights) < 0 or not sum(weights):
        raise ValueError("each domain has its options and a weight, none below 0 and one above")
    scale = sum(weights) if link == "mean" else 1.0
    rows = reduce(lambda a, b: a.join(b, "id"), [f.arrays.select("id", F.col("seq").alias(f"q{n}"), *(["weight"] if n == 0 else [])) for n, f in enumerate(domains)])
    parts = [x for n in range(len(domains)) for x in (F.array(F.size(f"q{n}")), F.col(f"q{n}"))]
    frame = D.ArrayFrame(rows.select("id", F.concat(*parts).alias("seq"), "weight"), tuple(s for f in domains for s in f.states))
    return frame, D.SummedMeasure([D.measure(f, **o) for f, o in zip(domains, options, strict=True)], [w / scale for w in weights])


def domain_contributions(pairs: Sequence[DataFrame]) -> DataFrame:
    """(domain, share): each domain's share of the sum of all distances."""
    sums = reduce(lambda a, b: a.unionByName(b), [p.agg(F.lit(n).alias("domain"), F.sum("d").alias("s")) for n, p in enumerate(pairs)])
    total = sums.agg(F.sum("s").alias("t"))
    return sums.join(F.broadcast(total), how="cross").select("domain", (F.col("s") / F.nullif(F.col("t"), F.lit(0.0))).alias("share"))


def association(a: SequenceFrame, b: SequenceFrame) -> DataFrame:
    """(n, lrt, df, p_value, cramer_v) of the pooled cross table of two domains' states."""
    cells = a.long.select("id", "pos", F.col("code").alias("x"), "weight").join(b.long.select("id", "pos", F.col("code").alias("y")), ["id", "pos"]).groupBy("x", "y").agg(F.sum("weight").alias("n"))
    rows, columns = cells.groupBy("x").agg(F.sum("n").alias("r")), cells.groupBy("y").agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("whole"))
    joined = cells.join(rows, "x").join(columns, "y").join(F.broadcast(total), how="cross")
    expected = F.col("r") * F.col("c") / F.col("whole")
    sums = joined.agg(F.sum(2 * F.col("n") * F.log(F.col("n") / expected)).alias("lrt"), F.sum(F.col("n") * F.col("n") / expected).alias("q"), F.first("whole").alias("total"))
    kinds = rows.agg(F.count("*").alias("kx")).join(columns.agg(F.count("*").alias("ky")), how="cross")
    one = sums.join(kinds, how="cross")  # a row each
    least = F.least("kx", "ky") - 1
    df = ((F.col("kx") - 1) * (F.col("ky") - 1)).cast("int")
    out = one.select(F.col("total").alias("n"), "lrt", df.alias("df"), F.sqrt((F.col("q") - F.col("total")) / F.col("total") / F.nullif(least, F.lit(0))).alias("cramer_v"))

    def tails(batches):
        for batch in batches:
            p = [chi_square_tail(x, d) if d else 1.0 for x, d in zip(batch.column("lrt").to_pylist(), batch.column("df").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p_value"])

    return out.mapInArrow(tails, "n double, lrt double, df int, cramer_v double, p_value double")


def combined_typology(labels: Sequence[DataFrame]) -> DataFrame:
    """(id, type): the domains' cluster labels joined by hyphens; each of ``labels`` is (id, cluster)."""
    rows = reduce(lambda a, b: a.join(b, "id"), [x.select("id", F.col("cluster").cast("string").alias(f"c{n}")) for n, x in enumerate(labels)])
    return rows.select("id", F.concat_ws("-", *[f"c{n}" for n in range(len(labels))]).alias("type"))


def merge_sparse_types(types: DataFrame, pairs: DataFrame, min_size: int, min_silhouette: float = -1.0) -> DataFrame:
    """(id, type): types under ``min_size`` join the type that is nearest on average, smallest first, while the mean silhouette allows.

    The loop is over types; each step is a grouped pass over the pair table.
    """
    now, pairs = types, stored(pairs)
    while True:
        sizes = {r.type: r.n for r in now.groupBy("type").agg(F.count("*").alias("n")).collect()}  # a row per type
        small = sorted((n, t) for t, n in sizes.items() if n < min_size)
        if not small or len(sizes) < 3:
            return now
        name = small[0][1]
        a, b = now.select(F.col("id").alias("i"), F.col("type").alias("ti")), now.select(F.col("id").alias("j"), F.col("type").alias("tj"))
        near = D.both_ways(pairs).join(a.where(F.col("ti") == name), "i").join(b.where(F.col("tj") != name), "j").groupBy("tj").agg(F.avg("d").alias("m")).orderBy("m", "tj").first()
        if near is None:
            return now
        merged = now.select("id", F.when(F.col("type") == name, near.tj).otherwise(F.col("type")).alias("type"))
        if min_silhouette > -1.0:
            codes = merged.select("id", F.col("type").alias("cluster"), F.lit(1.0).alias("weight"))
            if silhouettes(pairs, codes).agg(F.avg("asw")).first()[0] < min_silhouette:
                return now
        now = merged


def linked_polyads(roles: Sequence[SequenceFrame], draws: int = 50, seed: int = 1, costs: list[list[float]] | None = None) -> DataFrame:
    """(id, observed, u, v): mean Hamming distance within each id's polyad, its mean gap to random polyads, and the share of them that are wider.

    A random polyad takes each further role from another id, by a seeded hash. Distances are of whole
    rows, so a draw is a join on ids and no pair table is built.
    """
    k = roles[0].n_states
    sm = K.padded_costs((costs or (1.0 - np.eye(k)).tolist()))
    arrays = [r.arrays.select("id", F.col("seq").alias(f"q{n}")) for n, r in enumerate(roles)]
    ids = arrays[0].select("id")

    n_ids = ids.count()
    places = stored(numbered(ids, ["id"]))
    spread = places.select("id", "n", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    joined = spread.join(arrays[0], "id")
    for n, other in enumerate(arrays[1:], 1):
        place = places.select(F.col("id").alias(f"i{n}"), F.col("n").alias(f"m{n}"))
        shift = F.when(F.col("draw") == 0, 0).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "draw", "id"), F.lit(n_ids)))
        joined = joined.withColumn(f"m{n}", F.pmod(F.col("n") + shift, F.lit(n_ids))).join(place, f"m{n}").join(other.withColumnRenamed("id", f"i{n}"), f"i{n}")
    names = [f"q{n}" for n in range(len(roles))]

    def width(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [np.array(batch.column(c).to_pylist()) for c in names]
            pairs = [sm[codes[a], codes[b]].sum(axis=1) for a in range(len(codes)) for b in range(a)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("draw"), pa.array(np.mean(pairs, axis=0))], names=["id", "draw", "w"])

    widths = joined.select("id", "draw", *names).mapInArrow(width, f"id {roles[0].long.schema['id'].dataType.simpleString()}, draw int, w double")
    seen = widths.where("draw = 0").select("id", F.col("w").alias("observed"))
    return widths.where("draw > 0").join(seen, "id").groupBy("id", "observed").agg(F.avg(F.col("w") - F.col("observed")).alias("u"), F.avg((F.col("w") > F.col("observed")).cast("double")).alias("v"))


def state_space(domains: Sequence[SequenceFrame]) -> DataFrame:
    """One row: combined states that are possible and seen, the share seen, of positions in the most frequent one, and states seen once."""
    seen = stored(combined_states(domains))
    possible = 1
    for d in domains:
        possible *= d.n_states
    one = seen.agg(F.count("*").alias("n_seen"), F.max("share").alias("largest"), F.count_if(F.col("n") <= 1).alias("n_once"))
    return one.select(F.lit(possible).cast("long").alias("n_possible"), "n_seen", (F.col("n_seen") / possible).alias("share_seen"), "largest", "n_once")


def leave_one_out(pairs: Sequence[DataFrame | Mismatches], rows: DataFrame, k: int) -> DataFrame:
    """(left_out, ari, jaccard): agreement of k-medoids on all domains' summed distances with those on all but one; ``pairs`` by domain.

    Over :class:`Mismatches` there is no pair table: the distances of sequences side by side are the sums.
    """
    from .clustering import agreement, k_medoids

    panels = all(isinstance(p, Mismatches) for p in pairs)
    rows = stored(rows)

    def summed(parts: Sequence[DataFrame | Mismatches]) -> DataFrame | Mismatches:
        if panels:
            return side_by_side(parts, rows)
        return reduce(lambda a, b: a.unionByName(b), parts).groupBy("i", "j").agg(F.sum("d").alias("d"))

    held = list(pairs) if panels else [stored(p.select("i", "j", "d")) for p in pairs]
    whole = stored(k_medoids(summed(held), rows, k).select("id", "cluster"))
    out = None
    for n in range(len(held)):
        other = stored(k_medoids(summed(held[:n] + held[n + 1 :]), rows, k).select("id", "cluster"))
        one = agreement(whole, other).select(F.lit(n).alias("left_out"), "ari", "jaccard")
        out = one if out is None else out.unionByName(one)
    return out


def sample_coverage(frame: SequenceFrame, samples: int, size: int, rare: int = 1, seed: int = 1) -> DataFrame:
    """(sample, n, n_distinct, rare_share): how many distinct sequences a weighted sample has, and which share of the rare ones it meets."""
    from .clustering import weighted_samples

    drawn = weighted_samples(D.unique_sequences(frame), samples, size, seed)
    few = D.unique_sequences(frame).where(F.col("n") <= rare).select("uid")
    total = few.agg(F.count("*").alias("all_rare"))
    per = drawn.join(few.withColumn("is_rare", F.lit(1)), "uid", "left").groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("n_distinct"), F.sum(F.coalesce("is_rare", F.lit(0))).alias("r"))
    return per.join(F.broadcast(total), how="cross").select("sample", "n", "n_distinct", (F.col("r") / F.nullif("all_rare", F.lit(0))).alias("rare_share"))
