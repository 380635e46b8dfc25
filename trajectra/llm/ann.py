"""Approximate nearest neighbours by stable projections and kd-trees, with a chi-square stopping test.

Vectors are scaled to length one, so the nearest by cosine are the nearest by distance, and are
projected to a few dimensions by a Gaussian matrix: the squared projected distance of two vectors
over their squared distance is chi-square with that many degrees of freedom. The projected space is
cut into cells by the top of a kd-tree, fitted on a bounded sample of projected vectors; every vector is indexed, in the
kd-tree of its cell, and crowded cells are cut into blocks of bounded rows. A query takes projected
neighbours in order of distance, leaf by leaf, and verifies them on the vectors themselves. It
stops when a vector as near as the k-th found so far would have come up by now with probability
``confidence``.

Two rounds: a query is first answered in its own cell; with the k-th distance known, it visits just
the other cells that the stopping test doesn't rule out.

Cases: vectors that are null, empty, zero, or hold nulls or non-finite components take no part; shorter
ones are read as ending in zeros; lengths of any size are scaled by a power of two first, which
changes no cosine; fewer candidates than k give them all; equal scores go to the smaller id; a query's own row is left out,
by its id; ids that repeat are candidates each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Dimensions of the projection, rows of a leaf, rows of a block (and of a cell), sampled points for the cells
#: and of them in each cell at least: cells keep their size up to 100 million vectors and grow beyond.
PROJECTED, LEAF, BLOCK, SAMPLE, CELL_SAMPLE = 8, 64, 8_000, 200_000, 16
CONFIDENCE = 0.99
#: Queries that meet one block at once.
QUERY_BLOCK = 1_000


def chi_square_cdf(x: float, degrees: int) -> float:
    """P(chi-square with an even number of degrees <= x)."""
    half = x / 2
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total if half < 700 else 1.0


def chi_square_bound(confidence: float, degrees: int) -> float:
    """The x at which the distribution reaches ``confidence``."""
    low, high = 0.0, 1_000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < confidence else (low, middle)
    return high


def projection(dimensions: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, PROJECTED))


class KdTree:
    """Median splits at the widest coordinate; leaves hold up to ``leaf`` rows. Boxes bound the rows of each node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.nodes: list[tuple] = []  # (rows) of a leaf, or (left, right)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.points = points
        self._build(np.arange(len(points)), leaf)
        self._finish()

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        mine = self.points[rows]
        low, high = mine.min(axis=0), mine.max(axis=0)
        self.nodes.append((rows,))
        self.low.append(low)
        self.high.append(high)
        axis = int((high - low).argmax())
        if len(rows) > leaf and high[axis] > low[axis]:
            order = np.argpartition(mine[:, axis], len(rows) // 2)
            left = self._build(rows[order[: len(rows) // 2]], leaf)
            right = self._build(rows[order[len(rows) // 2 :]], leaf)
            self.nodes[at] = (left, right)
        return at

    def _finish(self) -> None:
        held = [(at, node[0]) for at, node in enumerate(self.nodes) if len(node) == 1]
        self.leaf_rows = [rows for _, rows in held]
        self.leaf_low = np.stack([self.low[at] for at, _ in held])
        self.leaf_high = np.stack([self.high[at] for at, _ in held])

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves by least squared distance to the query, and those distances."""
        d = np.maximum(0.0, np.maximum(self.leaf_low - q, q - self.leaf_high))
        gaps = (d * d).sum(axis=1)
        order = np.argsort(gaps, kind="stable")
        return order, gaps[order]


def _scores(vectors: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Cosines in double precision; the same sum for the same numbers wherever they stand."""
    return (vectors * q).sum(axis=1) / (norms * q_norm)


def search(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, query: tuple[int, np.ndarray], projected: np.ndarray, k: int, bound: float, known: float) -> tuple[np.ndarray, np.ndarray]:
    """The best ids of a block and their scores; ``known``: a squared distance that k vectors elsewhere reach.

    Leaves are read in order of projected distance, a growing number at a time, until the test holds.
    """
    own, q = query
    q_norm = math.sqrt(float((q * q).sum()))
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    limit, at, step = known, 0, 1
    order, gaps = tree.leaves(projected)
    while at < len(order):
        # Equal distances may still hold smaller ids, so a gap of zero is always read.
        last = int(np.searchsorted(gaps, max(bound * limit, 1e-18), side="right"))
        if at >= last:
            break
        rows = np.concatenate([tree.leaf_rows[x] for x in order[at : min(last, at + step)]])
        at, step = min(last, at + step), step * 2
        scores = _scores(vectors[rows], norms[rows], q, q_norm)
        found = ids[rows]
        keep = found != own
        if len(best) == k:
            keep &= scores >= best[-1]
        found, scores = np.concatenate([best_ids, found[keep]]), np.concatenate([best, scores[keep]])
        top = np.lexsort((found, -scores))[:k]
        best_ids, best = found[top], scores[top]
        if len(best) == k:
            limit = min(limit, max(0.0, 2 - 2 * float(best[-1])))
    return best_ids, best


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Cells:
    """The top of a kd-tree over sampled projected points: boxes that fill the space."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.splits: list[tuple] = []  # (axis, value, left, right), or (cell,)
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        far = np.full(PROJECTED, np.inf)
        self._split(sample, cells, -far, far)

    def _split(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        at = len(self.splits)
        self.splits.append(())
        axis = int((points.max(axis=0) - points.min(axis=0)).argmax()) if len(points) else 0
        value = float(np.median(points[:, axis])) if len(points) else 0.0
        left = points[:, axis] < value if len(points) else np.zeros(0, bool)
        if cells < 2 or not left.any():
            self.splits[at] = (len(self.boxes),)
            self.boxes.append((low, high))
            return at
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = value
        first = self._split(points[left], cells // 2, low, below)
        second = self._split(points[~left], cells - cells // 2, above, high)
        self.splits[at] = (axis, value, first, second)
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            split = self.splits[at]
            if len(split) == 1:
                out[rows] = split[0]
                continue
            axis, value, first, second = split
            left = points[rows, axis] < value
            stack += [(first, rows[left]), (second, rows[~left])]
        return out

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each cell."""
        low = np.stack([b[0] for b in self.boxes])
        high = np.stack([b[1] for b in self.boxes])
        d = np.maximum(0.0, np.maximum(low - q, q - high))
        return (d * d).sum(axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors, filled up with zeros to one width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is about one."""
    _, power = np.frexp(np.abs(matrix).max(axis=1, initial=0.0))
    half = power // 2  # in two steps: one factor may be out of range
    return np.ldexp(np.ldexp(matrix, -half[:, None]), -(power - half)[:, None])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, confidence: float = CONFIDENCE, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` nearest to each of ``queries``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).dropDuplicates(["id"])
    schema = "query_id long, rank int, vec_id long, score double"
    n_rows, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n_rows:
        return spark.createDataFrame([], schema)
    width = max(width, asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    turn = projection(width)
    bound = chi_square_bound(confidence, PROJECTED)

    def project(matrix: np.ndarray) -> np.ndarray:
        return (matrix / np.sqrt((matrix**2).sum(axis=1))[:, None]) @ turn

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(project(_scaled(_matrix(batch.column("v"), width)))), pa.list_(pa.float64()))], names=["p"])

    chosen = rows.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).select("id")
    points = rows.join(F.broadcast(chosen.distinct()), "id", "left_semi").select("v").mapInArrow(sampled, "p array<double>").limit(SAMPLE).toArrow()
    cells = Cells(_matrix(points.column("p"), PROJECTED), min(max(1, points.num_rows // CELL_SAMPLE), max(1, n_rows // block)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scaled = _scaled(_matrix(batch.column("v"), width))
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(scaled) + 1) * width, pa.int32()), pa.array(scaled.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), held, pa.array(cells.of(project(scaled)))], names=["id", "v", "cell"])

    placed = materialize(rows.mapInArrow(place, "id long, v array<double>, cell long"), "placed")
    homes = materialize(asked.mapInArrow(place, "id long, v array<double>, cell long"), "queries")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("n_blocks"))
    indexed = placed.join(F.broadcast(blocks), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id", "v"), "n_blocks").alias("block"), F.lit(None).cast("double").alias("known"))

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, matrix = left.column("id").to_numpy(), _matrix(left.column("v"), width)
            tree, norms = KdTree(project(matrix)), np.sqrt((matrix * matrix).sum(axis=1))
            asked_ids, asked_matrix = right.column("id").to_numpy(), _matrix(right.column("v"), width)
            for own, q, p, known in zip(asked_ids.tolist(), asked_matrix, project(asked_matrix), right.column("known").to_pylist(), strict=True):
                found, scores = search(tree, ids, matrix, norms, (own, q), p, k, bound, math.inf if known is None else known)
                out[0].append(np.full(len(found), own))
                out[1].append(found)
                out[2].append(scores)
        columns = [np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))

    def ask(with_cells: DataFrame) -> DataFrame:
        """Queries, by cell, against all blocks of their cells; the block is sent once for each chunk of queries."""
        chunks = with_cells.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("n_chunks"))
        targets = indexed.join(F.broadcast(chunks), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1))).drop("n_chunks")
        sent = (
            with_cells.join(F.broadcast(blocks), "cell")
            .join(F.broadcast(chunks), "cell")
            .select("id", "v", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"), "known", F.pmod(F.xxhash64("id"), "n_chunks").alias("chunk"))
        )
        return targets.groupBy("cell", "block", "chunk").cogroup(sent.groupBy("cell", "block", "chunk")).applyInArrow(visit, "query_id long, vec_id long, score double")

    first = materialize(ask(homes.withColumn("known", F.lit(None).cast("double"))), "home-cell")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "vec_id"))), 1, k)
    reached = first.groupBy("query_id").agg(best.alias("best")).select(F.col("query_id").alias("id"), F.when(F.size("best") == k, F.greatest(F.lit(0.0), 2 + 2 * F.element_at("best", k)["cost"])).alias("known"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            index, cell = [], []
            knowns, home = batch.column("known").to_pylist(), batch.column("cell").to_pylist()
            for i, q in enumerate(project(_matrix(batch.column("v"), width))):
                gaps = cells.gaps(q)
                near = np.flatnonzero((gaps <= bound * (math.inf if knowns[i] is None else knowns[i])) | (gaps <= 1e-18))
                near = near[near != home[i]]
                index += [i] * len(near)
                cell += near.tolist()
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(cell, pa.int64()), batch.column("known").take(at)], names=["id", "v", "cell", "known"])

    second = materialize(homes.join(reached, "id", "left").select("id", "v", "cell", "known").mapInArrow(others, "id long, v array<double>, cell long, known double"), "other-cells")
    found = first.unionByName(ask(second))
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.cost")).alias("score"))
