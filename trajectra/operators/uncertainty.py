"""Timing uncertainty: replicated sequences with shifted transitions, and how distances vary over them.

Replicates are rows of one table; every draw is a hash of (seed, replicate, id, spell), so a
replicate is the same whatever the partitions, and a lost task is redone alike.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.functions.special import poisson_truncated

from .distances import ArrayFrame, block_pairs, pairwise, to_references
from .sequences import SequenceFrame
from .tables import numbered, stored


def error_distribution(mean_error: float, most: int) -> list[float]:
    """P(error = 0..most): a truncated Poisson whose mean is ``mean_error``."""
    if not 0 <= mean_error < most:
        raise ValueError("the mean error must lie between 0 and the largest")
    low, high = 0.0, 10.0 * most + 10
    for _ in range(200):
        rate = (low + high) / 2
        mean = sum(k * p for k, p in enumerate(poisson_truncated(rate, most)))
        low, high = (rate, high) if mean < mean_error else (low, rate)
    return poisson_truncated((low + high) / 2, most)


#: SQL for the positions at which the spells of ``seq`` begin.
STARTS = "filter(sequence(1, size(seq)), p -> p = 1 OR seq[p - 1] <> seq[greatest(p - 2, 0)])"


def _shift(errors: list[float], seed: int) -> str:
    """SQL for the drawn error of the spell ``k`` of an id and replicate, to either side."""
    cumulative, total = [], 0.0
    for p in errors:
        total += p
        cumulative.append(total)
    bounds = ", ".join(f"{c!r}D" for c in cumulative[:-1])
    u = f"((pmod(xxhash64({seed}, rep, id, k), {1 << 52}) + 0.5D) / {float(1 << 52)!r}D)"
    size = f"size(filter(array({bounds}), c -> c < {u}))" if bounds else "0"
    return f"({size}) * (IF(pmod(xxhash64({seed}, rep, id, k, 7), 2) = 0, 1, -1))"


def replicates(frame: SequenceFrame, n: int, errors: list[float], seed: int = 1, independent: bool = True) -> DataFrame:
    """(rep, id, seq, weight): replicate 0 is the data; in others each transition moves by a drawn error, to either side.

    ``independent``: transitions keep their order by clamping to their neighbours; else a shift carries on
    to all later transitions. Spells keep a length of one at least, and sequences theirs.
    """
    spread = frame.arrays.select("id", "seq", "weight", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("rep"))
    begin, shift = "element_at(starts, k)", _shift(errors, seed)
    n_spells = "size(starts)"
    if independent:
        low, high = f"IF(k = 1, 1, greatest({begin} + {shift}, a[k - 2] + 1))", f"size(seq) - ({n_spells} - k)"
        moved = f"aggregate(sequence(1, {n_spells}), cast(array() AS array<int>), (a, k) -> concat(a, array(cast(least({low}, {high}) AS int))))"
    else:
        moved = f"""aggregate(sequence(1, {n_spells}), named_struct('a', cast(array() AS array<int>), 's', 0),
          (z, k) -> named_struct('a', concat(z.a, array(cast(IF(k = 1, 1, least(greatest({begin} + z.s + {shift}, z.a[k - 2] + 1), size(seq) - ({n_spells} - k))) AS int))), 's', z.s + IF(k = 1, 0, {shift})), z -> z.a)"""
    rows = spread.withColumn("starts", F.expr(STARTS))
    rows = rows.withColumn("moved", F.expr(f"IF(rep = 0, starts, {moved})"))
    rebuilt = F.expr("transform(sequence(1, size(seq)), p -> seq[element_at(starts, size(filter(moved, m -> m <= p))) - 1])")
    return rows.select("rep", "id", rebuilt.alias("seq"), "weight")


def move_relative(durations: list[int], shifts: list[int]) -> list[int]:
    """Durations after each transition moved by its shift while the times to later transitions stay: the last spell makes up for it.

    What a spell lacks to give is taken from those before it (of an earlier transition) or from the
    last ones backwards (of a later one); what can't be given isn't moved. Spells may vanish, but
    keep their order, and the whole its length.
    """
    out, last = list(durations), len(durations) - 1

    def take(n: int, spells: range) -> int:
        given = 0
        for j in spells:
            part = min(out[j], n - given)
            out[j], given = out[j] - part, given + part
        return given

    for i, shift in enumerate(shifts):
        if shift < 0:
            out[last] += take(-shift, range(i, -1, -1))
        elif shift > 0:
            out[i] += take(shift, range(last, i, -1))
    return out


def relative_replicates(frame: SequenceFrame, n: int, errors: list[float], seed: int = 1) -> DataFrame:
    """(rep, id, seq, weight) as of ``replicates``, each shift moving all later transitions with it (``move_relative``)."""
    spread = frame.arrays.select("id", "seq", "weight", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("rep")).withColumn("starts", F.expr(STARTS))
    durations = "transform(starts, (s, i) -> coalesce(get(starts, i + 1), size(seq) + 1) - s)"
    shifts = f"IF(rep = 0 OR size(starts) < 2, cast(array() AS array<int>), transform(sequence(2, size(starts)), k -> cast({_shift(errors, seed)} AS int)))"
    rows = spread.select("rep", "id", "weight", F.transform("starts", lambda s: F.get("seq", s - 1)).alias("states"), F.expr(durations).alias("durations"), F.expr(shifts).alias("shifts"))

    def move(batches):
        for batch in batches:
            seqs = []
            for states, held, shifts in zip(*(batch.column(c).to_pylist() for c in ("states", "durations", "shifts")), strict=True):
                seqs.append([s for s, d in zip(states, move_relative(held, shifts), strict=True) for _ in range(d)])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("id"), pa.array(seqs, pa.list_(pa.int32())), batch.column("weight")], names=["rep", "id", "seq", "weight"])

    return rows.mapInArrow(move, f"rep int, id {rows.schema['id'].dataType.simpleString()}, seq array<int>, weight double")


def union_frame(rows: DataFrame, frame: SequenceFrame) -> tuple[SequenceFrame, DataFrame]:
    """The distinct sequences of all replicates, numbered from 0, as a table of their own; and (rep, id, uid), whose they are."""
    held = rows.select("rep", "id", "seq", "weight")
    distinct = stored(numbered(held.groupBy("seq").agg(F.sum("weight").alias("weight")).withColumn("h", F.xxhash64("seq")), ["h", "seq"], "uid"))
    owners = held.join(distinct.select("seq", "uid"), "seq").select("rep", "id", "uid")
    return ArrayFrame(distinct.select(F.col("uid").alias("id"), "seq", "weight"), frame.states), owners


def replicate_distances(rows: DataFrame, frame: SequenceFrame, method: str = "LCS", **options) -> DataFrame:
    """(rep, i, j, d), i < j over ids: distances within each replicate, by any measure.

    Sequences that several replicates or ids have are compared once, in one pair table, to which the
    replicates' ids are joined.
    """
    union, owners = union_frame(rows, frame)
    owners = stored(owners)
    pairs = pairwise(union, method, **options).select(F.col("i").alias("u"), F.col("j").alias("v"), "d")
    first = owners.select("rep", F.col("id").alias("a"), F.col("uid").alias("u"))
    second = owners.select("rep", F.col("id").alias("b"), F.col("uid").alias("v"))
    apart = pairs.join(first, "u").join(second, ["rep", "v"]).select("rep", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "d")
    equal = first.join(second, (first.rep == second.rep) & (first.u == second.v) & (first.a < second.b)).select(first.rep, first.a.alias("i"), second.b.alias("j"), F.lit(0.0).alias("d"))
    return apart.unionByName(equal)


def replicate_reference_distances(rows: DataFrame, frame: SequenceFrame, references: list[list[int]], method: str = "LCS", **options) -> DataFrame:
    """(rep, id, ref, d): each replicate's distances to given sequences; each distinct sequence is compared once."""
    union, owners = union_frame(rows, frame)
    near = to_references(union, references, method, **options).select(F.col("i").alias("uid"), "ref", "d")
    return owners.join(near, "uid").select("rep", "id", "ref", "d")


def spread_of(distances: DataFrame) -> DataFrame:
    """(i, j, observed, mean, sd, bias, mse) of (rep, i, j, d): each pair over the replicates, and against replicate 0."""
    drawn = F.when(F.col("rep") > 0, F.col("d"))
    one = distances.groupBy("i", "j").agg(F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("observed"), F.avg(drawn).alias("mean"), F.stddev_samp(drawn).alias("sd"), F.avg(drawn * drawn).alias("square"))
    return one.select("i", "j", "observed", "mean", "sd", (F.col("mean") - F.col("observed")).alias("bias"), (F.col("square") - 2 * F.col("mean") * F.col("observed") + F.col("observed") * F.col("observed")).alias("mse"))


def replicate_frame(rows: DataFrame, rep: int, frame: SequenceFrame) -> SequenceFrame:
    return ArrayFrame(rows.where(F.col("rep") == rep).select("id", "seq", "weight"), frame.states)


def hamming(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"] != p["y"])).cast("double")


def _replicated(rows: DataFrame) -> DataFrame:
    """(uid, seqs): each id's sequences, replicate 0 first."""
    return rows.groupBy(F.col("id").cast("long").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "seq"))), lambda x: x["seq"]).alias("seqs"))


def _mismatches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n, m): places at which the rows of x and y differ, counted in short integers."""
    kind = np.uint8 if max(x.max(initial=0), y.max(initial=0)) < 256 and min(x.min(initial=0), y.min(initial=0)) >= 0 else x.dtype
    p, q = np.ascontiguousarray(x.T.astype(kind)), np.ascontiguousarray(y.T.astype(kind))
    out = np.zeros((len(x), len(y)), np.int16 if x.shape[1] < 2**15 else np.int32)
    for one, other in zip(p, q, strict=True):
        out += one[:, None] != other[None]
    return out


def _hamming_blocks(a: pa.Table, b: pa.Table, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and (replicates, pairs) distances of two blocks."""
    u, v = a.column("uid").to_numpy(), b.column("uid").to_numpy()
    x, y = np.array(a.column("seqs").to_pylist()), np.array(b.column("seqs").to_pylist())  # (ids, replicates, positions)
    keep = u[:, None] < v[None] if same else np.ones((len(u), len(v)), bool)
    rows, columns = np.nonzero(keep)
    if not len(rows):
        return np.minimum(u[rows], v[columns]), np.maximum(u[rows], v[columns]), np.zeros((x.shape[1] if x.ndim == 3 else 0, 0))
    d = np.stack([_mismatches(x[:, r], y[:, r])[rows, columns] for r in range(x.shape[1])]).astype(float)
    return np.minimum(u[rows], v[columns]), np.maximum(u[rows], v[columns]), d


def distance_spread(rows: DataFrame, method: str = "HAM") -> DataFrame:
    """(i, j, observed, mean, sd, bias, mse): each pair's Hamming distance over the replicates, and against that of the data.

    Ids are compared in pairs of blocks, all replicates of a pair together.
    """
    if method != "HAM":
        raise ValueError("the spread is of Hamming distances")

    def compare(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        i, j, d = _hamming_blocks(a, b, same)
        seen, drawn = (d[0], d[1:]) if len(d) else (np.zeros(0), np.zeros((0, 0)))
        mean = drawn.mean(axis=0) if len(drawn) else np.full(len(i), np.nan)
        sd = drawn.std(axis=0, ddof=1) if len(drawn) > 1 else np.full(len(i), np.nan)
        mse = ((drawn - seen) ** 2).mean(axis=0) if len(drawn) else np.full(len(i), np.nan)
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), **{n: pa.array(x, pa.float64()) for n, x in (("observed", seen), ("mean", mean), ("sd", sd), ("bias", mean - seen), ("mse", mse))}})

    return block_pairs(_replicated(rows), compare, "i long, j long, observed double, mean double, sd double, bias double, mse double")


def spread_ratios(spread: DataFrame) -> DataFrame:
    """(i, j, z): observed over the replicates' deviation."""
    return spread.select("i", "j", (F.col("observed") / F.nullif("sd", F.lit(0.0))).alias("z"))


def replicate_correlation(rows: DataFrame) -> DataFrame:
    """(rep, r): correlation of a replicate's distances with those of the data; blocks give sums."""

    def compare(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        _, _, d = _hamming_blocks(a, b, same)
        reps = np.arange(1, max(1, len(d)))
        x, y = (d[0], d[1:]) if len(d) else (np.zeros(0), np.zeros((0, 0)))
        sums = [np.full(len(reps), float(len(x))), np.full(len(reps), x.sum()), y.sum(axis=1), np.full(len(reps), (x * x).sum()), (y * y).sum(axis=1), (y * x).sum(axis=1)]
        return pa.table({"rep": pa.array(reps, pa.int32()), **{n: pa.array(v, pa.float64()) for n, v in zip(("n", "x", "y", "xx", "yy", "xy"), sums, strict=True)}})

    parts = block_pairs(_replicated(rows), compare, "rep int, n double, x double, y double, xx double, yy double, xy double")
    one = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    return one.select("rep", F.expr("(n * xy - x * y) / nullif(sqrt((n * xx - x * x) * (n * yy - y * y)), 0)").alias("r"))


def distinct_counts(rows: DataFrame) -> DataFrame:
    """(rep, n_unique)."""
    return rows.groupBy("rep").agg(F.countDistinct("seq").alias("n_unique"))


def replicate_agreement(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ari, jaccard): agreement of a replicate's k-medoids with those of the data; each replicate is a panel, so that there is no matrix."""
    from .clustering import agreement, k_medoids
    from .mismatches import Mismatches

    rows = stored(rows)
    states = tuple(str(c) for c in range(rows.agg(F.max(F.array_max("seq"))).first()[0] or 0))
    known, out = None, None
    for rep in sorted(r.rep for r in rows.select("rep").distinct().collect()):  # the loop is over the replicates
        own = rows.where(F.col("rep") == rep).select("id", "seq", F.lit(1.0).alias("weight"))
        labels = stored(k_medoids(Mismatches.of_rows(ArrayFrame(own, states)), own.select("id", "weight"), k).select("id", "cluster"))
        if rep == 0:
            known = labels
            continue
        one = agreement(labels, known).select(F.lit(rep).cast("int").alias("rep"), "ari", "jaccard")
        out = one if out is None else out.unionByName(one)
    return rows.sparkSession.createDataFrame([], "rep int, ari double, jaccard double") if out is None else out
