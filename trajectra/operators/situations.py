"""Situations (a state at a position), compared by the futures of those who are in them, and the axes that they span.

How often two situations are met by the same sequences is counted in one pass: each task adds up its
sequences in a table of situations squared, so what is shuffled doesn't grow with them. From then on
there are only situations, ``MOST_SITUATIONS`` of them at most, and the driver works on their
matrices: futures discounted by time, squared distances of these, their double centring, and
principal components of that. Sequences' coordinates are sums of their situations' scores, by
another narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import SequenceFrame

#: Situations that are met at all: their matrices take 8 bytes a pair.
MOST_SITUATIONS = 2_000


@dataclass(frozen=True)
class Situations:
    """The situations of a table in order of position and state, and their matrices."""

    pos: np.ndarray
    code: np.ndarray
    weight: np.ndarray
    together: np.ndarray  # weight of the sequences in both, the first not after the second

    def place(self) -> np.ndarray:
        """Their numbers by position and code; -1 where there is none."""
        found = np.full((self.pos.max(initial=0) + 1, self.code.max(initial=0) + 1), -1)
        found[self.pos, self.code] = np.arange(len(self.pos))
        return found

    def rates(self) -> np.ndarray:
        """The share of those in a situation who are in another one, at no earlier position."""
        return self.together / self.weight[:, None]

    def profiles(self, a: float = 1.0, b: float = 1.0) -> np.ndarray:
        """Each situation's rates over a * lag + b, which add up to one."""
        lag = np.maximum(self.pos[None] - self.pos[:, None], 0)
        discounted = self.rates() / (a * lag + b)
        return discounted / discounted.sum(axis=1, keepdims=True)

    def distances(self, a: float = 1.0, b: float = 1.0) -> np.ndarray:
        """Squared distances of the profiles, each situation weighted by one over its sum over profiles."""
        p = self.profiles(a, b)
        scaled = p / p.sum(axis=0)
        square = (scaled * p).sum(axis=1)
        return np.maximum(square[:, None] + square[None] - 2 * scaled @ p.T, 0.0)

    def centred(self, a: float = 1.0, b: float = 1.0) -> np.ndarray:
        d = self.distances(a, b)
        return -0.5 * (d - d.mean(axis=0) - d.mean(axis=1, keepdims=True) + d.mean())

    def components(self, a: float = 1.0, b: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, loadings, standard deviations) of the correlation matrix's components, greatest first; a loading's first element isn't negative."""
        x = self.centred(a, b)
        x = x - x.mean(axis=0)
        spread = np.sqrt((x * x).mean(axis=0))
        if not len(x) or (spread == 0).any():
            raise ValueError("a situation that differs from none has no components")
        x = x / spread
        values, loadings = np.linalg.eigh(x.T @ x / len(x))
        loadings = loadings[:, ::-1] * np.where(loadings[0, ::-1] < 0, -1.0, 1.0)
        return x @ loadings, loadings, np.sqrt(np.maximum(values[::-1], 0.0))


def situations(frame: SequenceFrame) -> Situations:
    """Count the situations and how they are met together."""
    met = frame.long.groupBy("pos", "code").agg(F.sum("weight").alias("weight")).limit(MOST_SITUATIONS + 1).collect()
    if len(met) > MOST_SITUATIONS:
        raise ValueError(f"there are more than {MOST_SITUATIONS} situations: take fewer positions or states")
    met = sorted((r for r in met if r.weight), key=lambda r: (r.pos, r.code))
    pos, code, weight = (np.array([r[c] for r in met], t) for c, t in (("pos", int), ("code", int), ("weight", float)))
    plain = Situations(pos, code, weight, np.zeros((0, 0)))
    place, size = plain.place(), len(pos)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size, size))
        for batch in batches:
            for own, w in zip(_own(place, batch), batch.column("weight").to_pylist(), strict=True):
                table[np.ix_(own, own)] += w
        i, j = np.nonzero(np.triu(table))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(table[i, j])], names=["i", "j", "w"])

    together = np.zeros((size, size))
    if size:
        for r in _met(frame).mapInArrow(count, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).toLocalIterator():  # situations squared
            together[r.i, r.j] = r.w
    return Situations(pos, code, weight, together)


def _met(frame: SequenceFrame) -> DataFrame:
    """(id, pos, code, weight): each sequence's positions with their states."""
    met = frame.long.groupBy("id").agg(F.collect_list(F.struct("pos", "code")).alias("x"), F.first("weight").alias("weight"))
    return met.select("id", F.col("x.pos").alias("pos"), F.col("x.code").alias("code"), "weight")


def _own(place: np.ndarray, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The situations of each sequence."""
    for pos, code in zip(batch.column("pos").to_pylist(), batch.column("code").to_pylist(), strict=True):
        found = place[pos, code]
        yield np.sort(found[found >= 0])


def situation_correlations(frame: SequenceFrame, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """(pos1, s1, pos2, s2, r): how alike two situations' distances to all others are; the first is not after the second."""
    s = situations(frame)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.atleast_2d(np.corrcoef(s.centred(a, b), rowvar=False)) if len(s.pos) else np.zeros((0, 0))
    i, j = np.triu_indices(len(s.pos))
    rows = pa.table({"pos1": s.pos[i].astype(np.int32), "s1": s.code[i].astype(np.int32), "pos2": s.pos[j].astype(np.int32), "s2": s.code[j].astype(np.int32), "r": r[i, j]})
    return frame.long.sparkSession.createDataFrame(rows)


def situation_components(frame: SequenceFrame, a: float = 1.0, b: float = 1.0, components: int = 2) -> DataFrame:
    """(pos, state, weight, component, score): each situation's scores."""
    s = situations(frame)
    scores = s.components(a, b)[0][:, :components]
    i, c = (x.ravel() for x in np.indices(scores.shape))
    rows = pa.table({"pos": s.pos[i].astype(np.int32), "state": [frame.states[x - 1] if x <= len(frame.states) else None for x in s.code[i]], "weight": s.weight[i], "component": (c + 1).astype(np.int32), "score": scores.ravel()})
    return frame.long.sparkSession.createDataFrame(rows)


def sequence_coordinates(frame: SequenceFrame, a: float = 1.0, b: float = 1.0, components: int = 2) -> DataFrame:
    """(id, coordinates): the sums of the situations' scores, an array of ``components``. A narrow pass; scores travel with the task."""
    s = situations(frame)
    scores, place = s.components(a, b)[0][:, :components], s.place()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores[own].sum(axis=0) for own in _own(place, batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tolist() for x in found], pa.list_(pa.float64()))], names=["id", "coordinates"])

    return _met(frame).mapInArrow(project, f"id {frame.long.schema['id'].dataType.simpleString()}, coordinates array<double>")
