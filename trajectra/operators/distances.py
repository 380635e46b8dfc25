"""Pairwise dissimilarities of sequences.

Equal sequences are compared once: the distinct ones get an id, are cut into blocks, and the pairs
of blocks on and above the diagonal are compared in Arrow batches by numpy kernels that work on all
pairs of two blocks together. A block is sent once for each block it meets, as one compressed row, blocks are of bounded
size, and tasks of equal work, whose pairs leave them part by part, so nothing is held whole. The result is a pair table (i, j, d) with
i < j over the distinct sequences' ids, with :func:`expand` to the rows' own. Blocks are ranges of ids, so that i stays the same in a run of
pairs and j repeats, and measures of common ends take alike sequences one after another, so that d repeats: the table is then stored in few bytes.

Two rewrites come before the kernels: OM whose substitutions all cost two indels or more is scaled
LCS, and complete EUCLID profiles of single positions are a count of mismatches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.functions import kernels as K

from . import transitions as T
from .sequences import SequenceFrame
from .tables import stored

#: Distinct sequences of a block at most and at least, and of a tile of it: the cells of a pair of tiles stay in the cache.
BLOCK, LEAST_BLOCK, TILE = 512, 96, 96
#: The second side of a tile where a step of the kernel is short beside its call.
WIDE_TILE = 256
#: Distinct sequences that travel together at most, and pairs of such blocks that a task compares, one after another.
SHIPPED, PAIRS_A_TASK = 4096, 32
#: Pairs with the same i, one after another: a page of a stored table then has the same j many times.
RUN = 128
#: Codes as they are, and as they travel.
WIDE, NARROW = pa.int32(), pa.int8()
#: Distinct sequences whose pairs are compared without being asked for: any number, as a task holds two blocks alone.
MOST_UNIQUE: int | None = None
#: Copies of a sequence that are expanded together, and rows of a task that expands.
CHUNK, CHUNK_ROWS = 1024, 4_000_000
SPELL_METHODS = ("LCPspell", "RLCPspell", "LCPmst", "RLCPmst", "LCPprod", "RLCPprod", "OMspell", "OMspellRS", "OMtspell", "NMSMST", "SVRspell")
METHODS = ("OM", "LCS", "LCP", "RLCP", "HAM", "DHD", "OMloc", "OMslen", "OMstran", "TWED", "NMS", "CHI2", "EUCLID", *SPELL_METHODS)
AUTO_NORM = {
    "OM": "maxlength", "HAM": "maxlength", "DHD": "maxlength", "LCS": "gmean", "LCP": "gmean", "RLCP": "gmean", "LCPspell": "maxdist", "RLCPspell": "maxdist",
    "LCPmst": "maxdist", "RLCPmst": "maxdist", "LCPprod": "none", "RLCPprod": "none", "TWED": "TWED", "CHI2": "auto", "EUCLID": "auto",
}


def unique_sequences(frame: SequenceFrame) -> DataFrame:
    """(uid, seq, n, weight): distinct sequences, numbered by the least id that has them."""
    return frame.arrays.groupBy("seq").agg(F.min("id").cast("long").alias("uid"), F.count("*").alias("n"), F.sum("weight").alias("weight")).select("uid", "seq", "n", "weight")


def _cast(rows: pa.Table, kind: pa.DataType, other: pa.DataType) -> pa.Table:
    """Columns of lists of one kind as lists of another, where it has all their values."""
    for at, field in enumerate(rows.schema):
        if pa.types.is_list(field.type) and field.type.value_type == kind:
            try:
                rows = rows.set_column(at, field.name, rows.column(at).cast(pa.list_(other)))
            except pa.ArrowInvalid:  # codes beyond it stay as they are
                continue
    return rows


def _opened(held: pa.Scalar) -> pa.Table:
    """The rows of a block that :func:`_packed` made."""
    return _cast(pa.ipc.open_stream(held.as_buffer()).read_all(), NARROW, WIDE)


def _packed(unique: DataFrame, place: Column, arrange: Callable[[pa.Table], pa.Table] = lambda rows: rows) -> DataFrame:
    """(b, rows): the rows of each block, in order of uid or as ``arrange`` puts them, as one compressed row."""

    def pack(table: pa.Table) -> pa.Table:
        rows = _cast(arrange(table.drop_columns(["b"]).sort_by("uid")), WIDE, NARROW)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        return pa.table({"b": table.column("b")[:1], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return unique.withColumn("b", place.cast("int")).groupBy("b").applyInArrow(pack, "b int, rows binary")


def against_all(unique: DataFrame, run: Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.Table]], schema: str, n_unique: int | None = None, block: int = SHIPPED) -> DataFrame:
    """Run ``run`` on each block and all blocks, its own too, one after another: sums over all rows then leave a task as a row for each of its own."""
    n_unique = unique.count() if n_unique is None else n_unique
    block = min(block, max(LEAST_BLOCK, math.ceil(n_unique / 64)))
    blocks = max(1, math.ceil(n_unique / block))
    packed = _packed(unique, F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    met = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = met.repartitionById(blocks, F.col("o")).sortWithinPartitions("o", F.col("b") != F.col("o"), "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((o.as_py(), b.as_py(), held) for batch in batches for o, b, held in zip(*(batch.column(c) for c in ("o", "b", "rows")), strict=True))
        for o, group in groupby(rows, lambda row: row[0]):
            tables = ((b, _opened(held)) for _, b, held in group)
            b, own = next(tables)
            if b == o:  # a block without rows has none of its own
                for table in run(own, chain([own], (other for _, other in tables))):
                    yield from table.to_batches()

    return dealt.mapInArrow(each, schema)


def packed_pairs(unique: DataFrame, run: Callable[[pa.Table, pa.Table, bool], Iterator[pa.Table]], schema: str, n_unique: int | None = None, block: int = SHIPPED, most: int | None = MOST_UNIQUE, ordered: bool = False, arrange: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """Run ``run`` on each pair of blocks (the last argument: whether it is one block with itself), whose tables leave the task one by one.

    A block travels as one compressed row, in order of uid, or as ``arrange`` puts its rows, once to each block it meets. ``ordered``: blocks are ranges of
    uid, so that the first block of two has the lesser ones; ``unique`` is stored once, as it is read to find the ranges. An error
    beyond ``most`` rows, if given.
    """
    unique = stored(unique) if ordered else unique
    n_unique = unique.count() if n_unique is None else n_unique
    if most is not None and n_unique > most:
        raise ValueError(f"{n_unique} distinct sequences have {n_unique * (n_unique - 1) // 2} pairs: raise `most` ({most}), or use clara or distances to references")
    # Few large blocks, but enough of them to keep many tasks busy.
    block = min(block, max(LEAST_BLOCK, math.ceil(n_unique / 16)))
    blocks = max(1, math.ceil(n_unique / block))
    place = F.pmod(F.xxhash64("uid"), F.lit(blocks))
    if ordered and blocks > 1:
        bounds = sorted(set(unique.approxQuantile("uid", [k / blocks for k in range(1, blocks)], 1 / (16 * blocks))))
        place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: F.col("uid") > bound))

    packed = _packed(unique, place, arrange) if arrange else _packed(unique, place)
    spark = unique.sparkSession
    pairs = blocks * (blocks + 1) // 2
    parts = min(pairs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_A_TASK)))
    met = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "rows")
    number = (F.col("bj") * (F.col("bj") + 1) / 2 + F.col("bi")).cast("int")
    dealt = met.repartitionById(parts, F.pmod(number, F.lit(parts))).sortWithinPartitions("bi", "bj", "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None
        for batch in batches:
            for bi, bj, b, rows in zip(*(batch.column(c) for c in ("bi", "bj", "b", "rows")), strict=True):
                pair, held = (bi.as_py(), bj.as_py()), _opened(rows)
                if pair[0] == pair[1]:
                    found = run(held, held, True)
                elif b.as_py() == pair[0]:
                    first = pair, held
                    continue
                elif first is not None and first[0] == pair:
                    found = run(first[1], held, False)
                else:  # the block it meets has no rows
                    continue
                for table in found:
                    yield from table.to_batches()

    return dealt.mapInArrow(each, schema)


def block_pairs(unique: DataFrame, compare: Callable, schema: str, n_unique: int | None = None, block: int = BLOCK, most: int | None = MOST_UNIQUE, ordered: bool = False, prepare: Callable[[pa.Table], object] = lambda rows: rows, arrange: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """Run ``compare`` on each pair of blocks of at most ``block`` rows (the last argument: whether it is one block with itself), each a table that ``prepare`` is applied to once.

    ``ordered``: the first block of two has the lesser uids. ``arrange`` puts the rows of two blocks that meet in another order;
    a block with itself is in order of uid. An error beyond ``most`` rows, if given.
    """

    def run(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.Table]:
        if arrange and same:
            a = b = a.sort_by("uid")
        columns = [prepare(b.slice(at, block)) for at in range(0, b.num_rows, block)]
        for p, at in enumerate(range(0, a.num_rows, block)):
            rows = columns[p] if same else prepare(a.slice(at, block))
            for q in range(p if same else 0, len(columns)):
                yield compare(rows, columns[q], same and p == q)

    return packed_pairs(unique, run, schema, n_unique, min(SHIPPED, 8 * block), most, ordered, arrange)


@dataclass
class Measure:
    """How a pair of blocks is compared; ``prepare`` makes a kernel's block from states."""

    kernel: Callable[[K.Block, K.Block], K.Raw]
    norm: str
    spells: bool = False
    position_spells: bool = False
    heavy: bool = False
    columns: int = TILE  # sequences of the second block in a tile
    directed: bool = False  # whether the two directions differ; a pair is then compared from its lesser uid
    backward: bool | None = None  # of measures of common ends: whether it is the last items that are compared

    def block(self, sequences: list[list[int]]) -> K.Block:
        if self.spells:
            both = [K.spells_of(s) for s in sequences]
            return K.Block.of([s for s, _ in both], [d for _, d in both])
        if self.position_spells:
            return K.Block.of(sequences, [[float(x) for x in np.repeat(K.spells_of(s)[1], K.spells_of(s)[1])] for s in sequences])
        return K.Block.of(sequences)

    def alike(self, rows: K.Block) -> np.ndarray:
        """An order in which neighbours have the same size and long common ends, so that their distances to others are mostly the same."""
        x, keys = K._reversed(rows) if self.backward else rows, []
        for t in reversed(range(x.codes.shape[1])):
            keys += [x.durations[:, t], x.codes[:, t]] if x.durations.size else [x.codes[:, t]]
        sizes = np.broadcast_to(self.kernel(rows, rows.part(0, 1))[2], (len(rows.lengths), 1))[:, 0]
        return np.lexsort([*keys, sizes])

    def distances(self, a: K.Block, b: K.Block) -> np.ndarray:
        """All distances of two blocks, tile by tile; in order of length, so that a tile is no wider than its sequences."""
        first, second = np.argsort(a.lengths, kind="stable"), np.argsort(b.lengths, kind="stable")
        a, b = a.take(first), b.take(second)
        found = np.zeros((len(a.lengths), len(b.lengths)))
        step, across = (48, 48) if self.heavy else (TILE, self.columns)
        columns = [(j, b.part(j, j + across)) for j in range(0, len(b.lengths), across)]
        for i in range(0, len(a.lengths), step):
            rows = a.part(i, i + step)
            for j, part in columns:
                found[i : i + step, j : j + across] = K.normalized(self.kernel(rows, part), self.norm)
        out = np.empty_like(found)
        out[np.ix_(first, second)] = found
        return out


@dataclass
class SummedMeasure:
    """Weighted sums of the measures of several domains, whose sequences stand one after another, each with its length before it."""

    measures: list[Measure]
    weights: list[float]

    def split(self, sequence: list[int]) -> list[list[int]]:
        parts, at = [], 0
        for _ in self.measures:
            parts.append(sequence[at + 1 : at + 1 + sequence[at]])
            at += 1 + sequence[at]
        return parts

    def block(self, sequences: list[list[int]]) -> list[K.Block]:
        by_domain = list(zip(*map(self.split, sequences), strict=True)) or [()] * len(self.measures)
        return [m.block(list(part)) for m, part in zip(self.measures, by_domain, strict=True)]

    def distances(self, a: list[K.Block], b: list[K.Block]) -> np.ndarray:
        return sum(w * m.distances(x, y) for w, m, x, y in zip(self.weights, self.measures, a, b, strict=True))


def measure(
    frame: SequenceFrame,
    method: str,
    costs: list[list[float]] | str | None = None,
    indel: float | list[float] | None = None,
    norm: str = "none",
    expansion: float = 0.1,
    context: float | None = None,
    link: str = "mean",
    power: float = 0.5,
    weight: float = 0.5,
    reference: float = 1.0,
    tokens: list[float] | None = None,
    stiffness: float = 0.5,
    penalty: float = 0.5,
    subsequence_weights: list[float] | None = None,
    proximity: list[list[float]] | None = None,
    symmetric: bool = False,
) -> Measure:
    """The comparison that ``method`` and its parameters say; costs that depend on the data are computed once, over all of it."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    k = frame.n_states
    norm = AUTO_NORM.get(method, "YujianBo") if norm == "auto" else norm
    if isinstance(costs, str):
        value = 4.0 if method == "DHD" else 2.0
        table = {"RATE": lambda: T.rate_costs(frame, value), "CONSTANT": lambda: T.constant_costs(frame, 1.0 if method == "HAM" else 2.0), "INDELS": lambda: T.indel_costs(frame), "INDELSLOG": lambda: T.indel_costs(frame, True), "FUTURE": lambda: T.future_costs(frame)}[costs]()
        costs = T.cost_matrix(table, k)
    if costs is None:
        costs = ((1.0 if method == "HAM" else 2.0) * (1 - np.eye(k))).tolist()
    table = np.asarray(costs, float)
    if (table < 0).any() or not np.isfinite(table).all():
        raise ValueError("costs must be finite and not negative")
    sm = K.padded_costs(table.tolist()) if table.ndim == 2 else np.stack([K.padded_costs(t.tolist()) for t in table])
    if indel is None:
        indel = T.default_indel(table.ravel().tolist())
        if method == "TWED":
            indel = 2 * indel * 2 + stiffness + penalty
    into = np.r_[0.0, np.full(k, indel) if np.isscalar(indel) else np.asarray(indel, float)]
    prox = K.padded_costs(proximity) if proximity is not None else None
    if method == "OM":
        off = table[~np.eye(k, dtype=bool)]
        if np.isscalar(indel) and len(off) and off.min() >= 2 * indel:  # no substitution ever pays
            scale = float(indel)

            def scaled(a: K.Block, b: K.Block) -> K.Raw:
                d, *_ = K.longest_common_subsequence(a, b)
                m, n = a.lengths[:, None], b.lengths[None]
                return scale * d, np.abs(m - n) * scale + 2 * scale * np.minimum(m, n), m * scale, n * scale

            return Measure(scaled, norm)
        whole = K._whole([sm, into], 1.0)[0] is not np.float64
        return Measure(lambda a, b: K.optimal_matching(a, b, sm, into), norm, columns=WIDE_TILE if whole else TILE)
    if method == "OMloc":
        around = 1 - 2 * expansion if context is None else context
        if symmetric:
            return Measure(lambda a, b: K.localized_gaps(a, b, sm, expansion, around), norm)
        return Measure(lambda a, b: K.localized(a, b, sm, expansion, around), norm, directed=True)
    if method == "OMslen":
        return Measure(lambda a, b: K.spell_length_sensitive(a, b, sm, into, power, link), norm, position_spells=True)
    if method in ("OMspell", "OMtspell", "OMspellRS"):
        by_state = None if tokens is None else np.r_[0.0, tokens]
        relative = reference if method == "OMspellRS" else None
        return Measure(lambda a, b: K.spell_matching(a, b, sm, into, weight, by_state, relative), norm, spells=True)
    if method == "TWED":
        if stiffness <= 0:
            raise ValueError("stiffness must be positive")
        return Measure(lambda a, b: K.time_warp(a, b, sm, stiffness, penalty, float(into.max())), norm)
    if method in ("HAM", "DHD"):
        return Measure(lambda a, b: K.hamming(a, b, sm), norm)
    if method == "LCS":
        return Measure(K.longest_common_subsequence, norm)
    backward = method.startswith("R")
    kind = method.removeprefix("R")
    if kind == "LCP":
        return Measure(lambda a, b: K.common_prefix(a, b, backward), norm, backward=backward)
    if kind == "LCPspell":
        return Measure(lambda a, b: K.common_spell_prefix(a, b, backward, weight, reference), norm, spells=True, backward=backward)
    if kind == "LCPmst":
        if norm == "maxlength":
            raise ValueError("LCPmst has no maxlength normalization")
        return Measure(lambda a, b: K.common_spell_time(a, b, backward), norm, spells=True, backward=backward)
    if kind == "LCPprod":
        if norm != "none":
            raise ValueError("LCPprod is raw only")
        return Measure(lambda a, b: K.common_spell_product(a, b, backward), norm, spells=True, backward=backward)
    if method in ("NMS", "NMSMST", "SVRspell"):
        what = {"NMS": "count", "NMSMST": "shared", "SVRspell": "product"}[method]
        return Measure(lambda a, b: K.subsequence_distance(a, b, subsequence_weights, prox, what), norm, spells=method != "NMS", heavy=True)
    raise ValueError(f"{method} has a function of its own")


def _table(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.Table:
    low, high = np.minimum(i, j), np.maximum(i, j)
    return pa.table({"i": pa.array(low, pa.int64()), "j": pa.array(high, pa.int64()), "d": pa.array(d, pa.float64())})


def _links(u: np.ndarray, v: np.ndarray, d: np.ndarray, same: bool) -> pa.Table:
    """The pair table of two blocks, each pair once."""
    if same:
        rows, columns = np.nonzero(u[:, None] < v[None])
        return _table(u[rows], v[columns], d[rows, columns])
    by_run = [(v[at : at + RUN], d[:, at : at + RUN]) for at in range(0, len(v), RUN)]
    parts = [(np.repeat(u, len(w)), np.tile(w, len(u)), part.ravel()) for w, part in by_run]
    return _table(*(np.concatenate(c) for c in zip(*parts, strict=True))) if parts else _table(v, v, d.ravel())


def pairwise(frame: SequenceFrame, method: str = "OM", block: int = BLOCK, most: int | None = MOST_UNIQUE, **options) -> DataFrame:
    """(i, j, d), i < j, over the distinct sequences' uids, of which there are ``most`` at most."""
    if method == "OMstran":
        return omstran(frame, block=block, most=most, **options)
    if method in ("CHI2", "EUCLID"):
        return profiles(frame, method, block=block, most=most, **options)
    if method in ("HAM", "DHD"):
        _equal_lengths(frame)
    how = measure(frame, method, **options)

    def prepare(rows: pa.Table) -> tuple:
        return rows.column("uid").to_numpy(), how.block(rows.column("seq").to_pylist())

    def compare(a: tuple, b: tuple, same: bool) -> pa.Table:
        return _links(a[0], b[0], how.distances(a[1], b[1]), same)  # of a directed measure's blocks, the first has the lesser uids

    def arrange(rows: pa.Table) -> pa.Table:
        return rows.take(how.alike(how.block(rows.column("seq").to_pylist()))) if rows.num_rows else rows

    alike = None if how.backward is None else arrange
    return block_pairs(unique_sequences(frame).select("uid", "seq"), compare, "i long, j long, d double", block=block, most=most, ordered=True, prepare=prepare, arrange=alike)


def _equal_lengths(frame: SequenceFrame) -> None:
    least, most = frame.arrays.agg(F.min(F.size("seq")), F.max(F.size("seq"))).first()
    if least != most:
        raise ValueError("the measure needs sequences of equal length")


def to_references(frame: SequenceFrame, references: list[list[int]], method: str | Measure | SummedMeasure = "OM", **options) -> DataFrame:
    """(i, ref, d): each distinct sequence against a given list of sequences; a narrow pass, the list travels with the task."""
    how = measure(frame, method, **options) if isinstance(method, str) else method

    def compare(batches):
        targets = how.block(references)
        for batch in batches:
            if batch.num_rows:
                d = how.distances(how.block(batch.column("seq").to_pylist()), targets)
                n, m = d.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("uid").to_numpy(), m)), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(d.ravel())], names=["i", "ref", "d"])

    return unique_sequences(frame).select("uid", "seq").mapInArrow(compare, "i long, ref int, d double")


def omstran(frame: SequenceFrame, otto: float = 0.5, indel: float | None = None, costs: list[list[float]] | None = None, transition_cost: float = 2.0, norm: str = "none", block: int = BLOCK, most: int | None = MOST_UNIQUE) -> DataFrame:
    """OM on states paired with the next one; a pair's cost is otto * state cost + (1 - otto) * transition cost.

    A transition costs ``transition_cost`` against another one; the last position pairs with itself.
    """
    k = frame.n_states
    sm = np.asarray(costs, float) if costs is not None else 2.0 * (1 - np.eye(k))
    pairs = [(a, b) for a in range(k) for b in range(k)]
    first, second = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    moved = first != second
    different = (first[:, None] != first[None]) | (second[:, None] != second[None])
    wide = otto * sm[first][:, first] + (1 - otto) * transition_cost * (different & (moved[:, None] | moved[None]))
    paired = frame.arrays.select("id", F.transform("seq", lambda s, i: (s - 1) * k + F.coalesce(F.get("seq", i + 1), s)).alias("seq"), "weight")
    shifted = ArrayFrame(paired, tuple(f"{a}>{b}" for a, b in pairs))
    return pairwise(shifted, "OM", block=block, most=most, costs=wide.tolist(), indel=wide.max() / 2 if indel is None else indel, norm=norm)


class ArrayFrame(SequenceFrame):
    """A sequence table made of arrays."""

    def __init__(self, arrays: DataFrame, states: tuple[str, ...]):
        long = arrays.select("id", F.posexplode("seq").alias("p", "code"), "weight").select("id", (F.col("p") + 1).alias("pos"), "code", "weight")
        super().__init__(long, states, states)
        self.__dict__["arrays"] = arrays


def profiles(frame: SequenceFrame, method: str = "CHI2", step: int = 1, breaks: list[tuple[int, int]] | None = None, overlap: bool = False, whole: bool = False, norm: str = "none", block: int = BLOCK, most: int | None = MOST_UNIQUE) -> DataFrame:
    """CHI2 and EUCLID: distances of the state shares in each period.

    ``breaks``: periods of positions from and to, inclusive; else each ``step`` positions. CHI2 weights a
    state by one over its share among all rows in the period (``whole``: over all periods).
    """
    k = frame.n_states
    length = frame.long.agg(F.max("pos")).first()[0] or 0
    if breaks is None:
        breaks = [(a, min(length, a + step - 1)) for a in range(1, length + 1, step)]
        if overlap and step > 1:
            half = step // 2
            breaks += [(a, min(length, a + step - 1)) for a in range(1 + half, length + 1 - half, step)]
    masses = np.ones(len(breaks) * k)
    if method == "CHI2":
        counts = np.zeros((length + 1, k + 1))
        for row in frame.long.groupBy("pos", "code").agg(F.sum("weight").alias("w")).collect():  # positions times states
            counts[row.pos, row.code] = row.w
        parts = [counts[a : b + 1].sum(axis=0)[1:] for a, b in breaks]
        if whole:
            parts = [np.sum(parts, axis=0)] * len(breaks)
        masses = np.concatenate([p / max(p.sum(), 1e-300) for p in parts])
    elif step == 1 and not overlap:
        masses *= 2.0  # a mismatch then counts one

    def profile(sequences: list[list[int]]) -> np.ndarray:
        codes = K.Block.of(sequences).codes
        one = np.eye(k + 1)[:, 1:]
        out = []
        for a, b in breaks:
            held = one[codes[:, a - 1 : b]].sum(axis=1)
            total = held.sum(axis=1, keepdims=True)
            out.append(np.divide(held, total, out=np.zeros_like(held), where=total > 0))
        return np.concatenate(out, axis=1)

    single = method == "EUCLID" and step == 1 and not overlap

    def prepare(rows: pa.Table) -> tuple:
        sequences = rows.column("seq").to_pylist()
        return rows.column("uid").to_numpy(), K.Block.of(sequences) if single else profile(sequences)

    def compare(a: tuple, b: tuple, same: bool) -> pa.Table:
        if single:
            d = np.sqrt(K.hamming(a[1], b[1], K.padded_costs((1.0 - np.eye(k)).tolist()))[0])
            d = d / math.sqrt(len(breaks)) if norm == "auto" else d
        else:
            d = K.profile_distance(a[1], b[1], masses, len(breaks), norm == "auto")
        return _links(a[0], b[0], d, same)

    return block_pairs(unique_sequences(frame).select("uid", "seq"), compare, "i long, j long, d double", block=block, most=most, ordered=True, prepare=prepare)


def expand(frame: SequenceFrame, pairs: DataFrame, most: int | None = MOST_UNIQUE) -> DataFrame:
    """(i, j, d), i < j, over the rows' ids: distances of equal sequences are zero. Grows with the square of the rows; an error beyond ``most``, if given."""
    n = frame.arrays.count()
    if most is not None and n > most:
        raise ValueError(f"{n} rows have {n * (n - 1) // 2} pairs: raise `most` ({most}), or work on the distinct sequences with weights")
    unique = unique_sequences(frame)
    # Copies of a sequence are held in chunks of bounded length; a task gets pairs of chunks, so that many copies of few sequences are spread too.
    of = frame.arrays.select("id", "seq").join(unique.select("uid", "seq", "n"), "seq")
    chunks = of.groupBy("uid", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).alias("c")).agg(F.collect_list("id").alias("ids"))
    a, b = chunks.select(F.col("uid").alias("i"), F.col("c").alias("ci"), F.col("ids").alias("p")), chunks.select(F.col("uid").alias("j"), F.col("c").alias("cj"), F.col("ids").alias("q"))
    links = pairs.select("i", "j", "d").unionByName(unique.select(F.col("uid").alias("i"), F.col("uid").alias("j"), F.lit(0.0).alias("d")))
    met = links.join(a, "i").join(b, "j").where("i < j OR ci <= cj")
    parts = max(frame.long.sparkSession.sparkContext.defaultParallelism, math.ceil(n * n / 2 / CHUNK_ROWS))
    each = met.repartition(parts, "i", "j", "ci", "cj").withColumn("p", F.explode("p")).withColumn("q", F.explode("q"))
    return each.where("i < j OR ci < cj OR p < q").select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "d")


def elzinga_studer(pairs: DataFrame, to_reference: DataFrame) -> DataFrame:
    """(i, j, d): 2d / (d + d(i, r) + d(j, r)), with ``to_reference`` as (i, r)."""
    a, b = to_reference.select("i", F.col("r").alias("ri")), to_reference.select(F.col("i").alias("j"), F.col("r").alias("rj"))
    total = F.col("d") + F.col("ri") + F.col("rj")
    return pairs.join(a, "i").join(b, "j").select("i", "j", F.when(total > 0, 2 * F.col("d") / total).otherwise(0.0).alias("d"))


def elzinga_studer_pairs(frame: SequenceFrame, reference: list[int], method: str = "HAM", block: int = BLOCK, most: int | None = MOST_UNIQUE, **options) -> DataFrame:
    """The same over a frame's distinct sequences: each block brings its own distances to the reference, so nothing is joined to the pairs."""
    if method in ("HAM", "DHD"):
        _equal_lengths(frame)
    how = measure(frame, method, **options)

    def prepare(rows: pa.Table) -> tuple:
        x = how.block(rows.column("seq").to_pylist())
        return rows.column("uid").to_numpy(), x, how.distances(x, how.block([reference]))[:, 0]

    def compare(a: tuple, b: tuple, same: bool) -> pa.Table:
        d = how.distances(a[1], b[1])
        total = d + a[2][:, None] + b[2][None]
        return _links(a[0], b[0], np.divide(2 * d, total, out=np.zeros_like(d), where=total > 0), same)

    return block_pairs(unique_sequences(frame).select("uid", "seq"), compare, "i long, j long, d double", block=block, most=most, ordered=True, prepare=prepare)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(i, j, d) in both directions."""
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def custom(frame: SequenceFrame, distance: Callable[[list[int], list[int]], float], block: int = BLOCK, most: int | None = MOST_UNIQUE) -> DataFrame:
    """(i, j, d) by a function of two sequences of codes, called for each pair of distinct ones, from the lesser uid."""

    def prepare(rows: pa.Table) -> tuple:
        return rows.column("uid").to_pylist(), rows.column("seq").to_pylist()

    def compare(a: tuple, b: tuple, same: bool) -> pa.Table:
        (u, x), (v, y) = a, b
        found = [(i, j, distance(p, q) if i < j else distance(q, p)) for i, p in zip(u, x, strict=True) for j, q in zip(v, y, strict=True) if (i < j or not same)]
        i, j, d = (np.array(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return _table(i.astype(np.int64), j.astype(np.int64), d.astype(float))

    return block_pairs(unique_sequences(frame).select("uid", "seq"), compare, "i long, j long, d double", block=block, most=most, ordered=True, prepare=prepare)
