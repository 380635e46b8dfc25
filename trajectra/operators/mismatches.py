"""Sums over the Hamming distances of all pairs of a panel's distinct sequences, without a pair table.

A distance is a number of positions that differ. A row's sum of distances to a group is the group's
weight at each position less that of the row's own state there, so sums within and between groups
follow from weights by group, position and state. What depends on single distances (the largest one,
the weight within a radius) is counted in the tasks that compare blocks, and gives a row per sequence.

Operators that take a pair table take a :class:`Mismatches` in its place where they read sums alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.functions import kernels as K

from .distances import ArrayFrame, _equal_lengths, packed_pairs, pairwise, unique_sequences
from .sequences import SequenceFrame
from .tables import stored

#: Rows and columns that are compared together: their arrays stay in the cache.
ROWS, COLUMNS = 128, 1024


class Mismatches:
    """Hamming distances of the distinct sequences of a frame whose sequences are of one length."""

    _stored = True  # has nothing to store

    def __init__(self, frame: SequenceFrame):
        _equal_lengths(frame)
        self.frame = frame
        self.k = frame.n_states

    @classmethod
    def of_rows(cls, frame: SequenceFrame) -> Mismatches:
        """The same of all rows by their ids, those with equal sequences too."""
        gaps = cls(frame)
        gaps.__dict__["unique"] = stored(frame.arrays.select(F.col("id").cast("long").alias("uid"), "seq"))
        return gaps

    @cached_property
    def unique(self) -> DataFrame:
        """(uid, seq), stored, as every sum reads it."""
        return stored(unique_sequences(self.frame).select("uid", "seq"))

    @cached_property
    def length(self) -> int:
        return self.frame.arrays.agg(F.max(F.size("seq"))).first()[0] or 0

    def pairs(self) -> DataFrame:
        """The pair table (i, j, d)."""
        return pairwise(self.frame, "HAM")

    def _long(self, rows: DataFrame) -> DataFrame:
        """(id, ..., pos, code) of ``rows``."""
        return rows.join(self.unique.select(F.col("uid").alias("id"), "seq"), "id").select(*rows.columns, F.posexplode("seq").alias("pos", "code"))

    def totals(self, rows: DataFrame) -> DataFrame:
        """(id, group, weight, total): the weighted sum of distances to the rows of one's own group; ``rows``: (id, weight, group)."""
        long = self._long(rows.select("id", "weight", "group"))
        counts = long.groupBy("group", "pos", "code").agg(F.sum("weight").alias("own"))
        sizes = counts.groupBy("group", "pos").agg(F.sum("own").alias("all"))
        sums = long.join(counts.join(sizes, ["group", "pos"]), ["group", "pos", "code"]).groupBy("id").agg(F.sum(F.col("all") - F.col("own")).alias("total"))
        return rows.join(sums, "id", "left").select("id", "group", "weight", F.coalesce("total", F.lit(0.0)).alias("total"))

    def within(self, rows: DataFrame) -> DataFrame:
        """(group, s): the sum of w_i w_j d over each group's pairs; ``rows``: (id, weight, group)."""
        counts = self._long(rows.select("id", "weight", "group")).groupBy("group", "pos", "code").agg(F.sum("weight").alias("w"))
        at = counts.groupBy("group", "pos").agg(((F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))) / 2).alias("s"))
        return at.groupBy("group").agg(F.sum("s").alias("s"))

    def cells(self, members: DataFrame, predictors: list[str]) -> list[tuple]:
        """(node, p, u, v, sum of w_i w_j d) for each node, predictor p and its values u <= v, over the node's pairs that have them; ``members``: (id, weight, node, ...).

        The driver gets weights by node, value, position and state.
        """
        values = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(p).cast("string").alias("u")) for p in predictors]))
        long = self._long(members.select("id", "weight", "node", values.alias("c")).select("id", "weight", "node", "c.p", "c.u"))
        found: dict[tuple, dict] = {}
        for r in long.groupBy("node", "p", "u", "pos", "code").agg(F.sum("weight").alias("w")).collect():
            table = found.setdefault((r.node, r.p), {}).setdefault(r.u, np.zeros((self.length, self.k + 1)))
            table[r.pos, r.code] = r.w
        out = []
        for (node, p), by_value in found.items():
            names = sorted(by_value, key=lambda u: (u is not None, u))
            held = np.stack([by_value[u] for u in names])
            sizes = held.sum(axis=2)
            flat = held.reshape(len(names), -1)
            gaps = sizes @ sizes.T - flat @ flat.T
            out += [(node, p, u, v, float(gaps[a, b]) / (2 if a == b else 1)) for a, u in enumerate(names) for b, v in enumerate(names) if a <= b]
        return out

    def set_sums(self, ids: np.ndarray, sets: np.ndarray, shares: np.ndarray) -> dict[int, np.ndarray]:
        """As ``permutations.set_sums``: weights by position and state of all groups and replicates are summed in one pass over the sequences."""
        n_groups, _, width = shares.shape
        length, k = self.length, self.k

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                uid = batch.column("uid").to_numpy()
                at = np.minimum(np.searchsorted(ids, uid), len(ids) - 1)
                known = np.flatnonzero(ids[at] == uid)
                codes = K.Block.of(batch.column("seq").to_pylist()).codes
                for s in np.unique(sets[at[known]]):
                    own = known[sets[at[known]] == s]
                    one = (codes[own][:, :, None] == np.arange(1, k + 1)).reshape(len(own), -1).astype(float)
                    part = np.stack([one.T @ shares[g][at[own]] for g in range(n_groups)])
                    found[int(s)] = found[int(s)] + part if int(s) in found else part
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v.ravel() for v in found.values()], pa.list_(pa.float64()))], names=["set", "s"])

        def add(table: pa.Table) -> pa.Table:
            held = table.column("s").combine_chunks()
            total = np.asarray(held.flatten()).reshape(table.num_rows, -1).sum(axis=0)
            w = total.reshape(n_groups, length, k, width)
            w = np.concatenate([w, w.sum(axis=0)[None]])
            s = ((w.sum(axis=2) ** 2 - (w**2).sum(axis=2)) / 2).sum(axis=1)
            return pa.table({"set": table.column("set")[:1], "s": pa.array([s.ravel()], pa.list_(pa.float64()))})

        rows = self.unique.mapInArrow(sums, "set long, s array<double>").groupBy("set").applyInArrow(add, "set long, s array<double>").collect()  # a row per set
        return {r["set"]: np.array(r.s).reshape(n_groups + 1, width) for r in rows}

    def largest(self, ids: DataFrame | None = None) -> float | None:
        """The largest distance, of ``ids`` (uid) alone if given; None without pairs."""
        k = self.k
        held = self.unique if ids is None else self.unique.join(ids, "uid", "left_semi")

        def run(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.Table]:
            x, y = _planes(a, k), _planes(b, k)
            if not same or a.num_rows > 1:
                most = max(int(K.mismatches(_part(x, i, ROWS), _part(y, j, COLUMNS)).max()) for i in range(0, a.num_rows, ROWS) for j in range(0, b.num_rows, COLUMNS))
                yield pa.table({"d": pa.array([most], pa.int32())})

        found = packed_pairs(held, run, "d int").agg(F.max("d")).first()[0]
        return None if found is None else float(found)

    def near(self, rows: DataFrame, limit: float) -> DataFrame:
        """(id, s): the weight of the other ``rows`` (id, weight) at a distance below ``limit``; rows with none may be left out."""
        k = self.k
        below = max(0, math.ceil(limit))  # distances are whole

        def run(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.Table]:
            x, y = _planes(a, k), _planes(b, k)
            u, v = a.column("weight").to_numpy(), b.column("weight").to_numpy()
            # Whole weights of a block add up exactly in single precision, which is twice as fast.
            kind = np.float32 if all((w == np.rint(w)).all() and w.sum() < 2**24 for w in (u, v)) else np.float64
            p, q = u.astype(kind), v.astype(kind)
            left, right = np.zeros(len(u)), np.zeros(len(v))
            for i in range(0, len(u), ROWS):
                for j in range(0, len(v), COLUMNS):
                    hit = (K.mismatches(_part(x, i, ROWS), _part(y, j, COLUMNS)) < below).astype(kind)
                    left[i : i + ROWS] += hit @ q[j : j + COLUMNS]
                    if not same:
                        right[j : j + COLUMNS] += p[i : i + ROWS] @ hit
            if same:
                yield pa.table({"id": a.column("uid"), "s": pa.array(left - u * (below > 0))})
            else:
                yield pa.table({"id": a.column("uid"), "s": pa.array(left)})
                yield pa.table({"id": b.column("uid"), "s": pa.array(right)})

        held = self.unique.join(rows.select(F.col("id").alias("uid"), F.col("weight").cast("double").alias("weight")), "uid")
        return packed_pairs(held, run, "id long, s double").groupBy("id").agg(F.sum("s").alias("s"))

    def _gaps(self, ids: list[int]) -> tuple[list[int], list[Column]]:
        """The ``ids`` that have a sequence, and each row's distance to them."""
        few = [(r.uid, list(r.seq)) for r in self.unique.where(F.col("uid").isin(ids)).orderBy("uid").collect()]  # a sequence per id asked for
        gaps = [F.aggregate(F.zip_with("seq", F.array(*map(F.lit, one)), lambda a, b: (a != b).cast("int")), F.lit(0), lambda total, x: total + x) for _, one in few]
        return [uid for uid, _ in few], gaps

    def to(self, ids: list[int]) -> DataFrame:
        """(id, other, d): the distance of each sequence to those of a few ``ids``."""
        others, gaps = self._gaps(ids)
        found = [F.struct(F.lit(other).cast("long").alias("other"), gap.cast("double").alias("d")) for other, gap in zip(others, gaps, strict=True)]
        none = F.array().cast("array<struct<other: bigint, d: double>>")
        return self.unique.select(F.col("uid").alias("id"), F.explode(F.array(*found) if found else none).alias("x")).select("id", "x.other", "x.d")

    def beside(self, ids: list[int], limit: float) -> DataFrame:
        """(id): the sequences at a distance below ``limit`` from one of ``ids``, themselves left out."""
        below = max(0, math.ceil(limit))
        _, gaps = self._gaps(ids)
        return self.unique.where(~F.col("uid").isin(ids) & (F.least(F.lit(2**31 - 1), *gaps) < below)).select(F.col("uid").alias("id"))


def side_by_side(panels: Sequence[Mismatches], rows: DataFrame) -> Mismatches:
    """Mismatches of the sequences of several domains together, of the ids of ``rows`` (id, ...): the sums of the domains' distances. Equal rows stay apart."""
    parts, codes = rows.select("id"), 0
    for n, panel in enumerate(panels):
        own = panel.frame.arrays.select("id", F.transform("seq", lambda s: s + codes).alias(f"q{n}"))  # noqa: B023
        parts, codes = parts.join(own, "id"), codes + panel.k
    whole = stored(parts.select("id", F.concat(*[f"q{n}" for n in range(len(panels))]).alias("seq"), F.lit(1.0).alias("weight")))
    return Mismatches.of_rows(ArrayFrame(whole, tuple(str(c) for c in range(codes))))


def _planes(rows: pa.Table, k: int) -> list[np.ndarray]:
    codes = rows.column("seq").combine_chunks()
    return K.bit_planes(np.asarray(codes.flatten()).reshape(rows.num_rows, -1), k)


def _part(planes: list[np.ndarray], at: int, step: int) -> list[np.ndarray]:
    return [p[:, at : at + step] for p in planes]
