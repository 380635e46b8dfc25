"""Sums of Hamming distances without pairs equal those over the pair table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.operators import discrepancy as A
from trajectra.operators import distances as D
from trajectra.operators import permutations as T
from trajectra.operators import representatives as R
from trajectra.operators import sequences as Q
from trajectra.operators import validation as V
from trajectra.operators.mismatches import Mismatches


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    rows = [(i, t, "abcd"[v], 1.0 + i % 4 / 2) for i in range(150) for t, v in enumerate(rng.integers(0, 4, 7), 1)]
    frame = Q.build(spark.createDataFrame(rows, "id long, pos int, s string, w double"), "id", "pos", "s", list("abcd"), weight="w")
    people = D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight", (F.col("uid") % 3).cast("int").alias("group"))
    return frame, D.pairwise(frame, "HAM"), Mismatches(frame), people.localCheckpoint()


def _same(one, other, *key):
    a, b = ({tuple(r[k] for k in key): r.asDict() for r in x.collect()} for x in (one, other))
    assert a.keys() == b.keys() and a
    for k, row in a.items():
        assert all(b[k][c] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v) for c, v in row.items()), (row, b[k])


def test_medoids(panel):
    _, pairs, sums, rows = panel
    _same(R.medoids(pairs, rows), R.medoids(sums, rows), "group")


def test_distances_to_center(panel):
    _, pairs, sums, rows = panel
    _same(A.distances_to_center(pairs, rows), A.distances_to_center(sums, rows), "id")


def test_association(panel):
    _, pairs, sums, rows = panel
    _same(A.association(pairs, rows), A.association(sums, rows), "n")


def test_set_associations(panel):
    _, pairs, sums, rows = panel
    sets = rows.withColumn("set", F.col("id") % 2)
    for weights in ("diss", "group"):
        _same(T.set_tests(pairs, sets, 9, weights=weights), T.set_tests(sums, sets, 9, weights=weights), "set")


def test_distance_tree_tested(panel):
    _, pairs, sums, rows = panel
    rows = rows.withColumns({"parity": F.col("id") % 2, "fifth": F.col("id") % 5})
    one, other = (A.distance_tree(p, rows, ["parity", "fifth"], min_size=10, max_depth=2, min_r2=0.0, replicates=9, max_p=1.0) for p in (pairs, sums))
    assert one[0].lines() == other[0].lines() and len(one[0].leaves()) > 1
    _same(one[1], other[1], "id")


def test_property_tree(panel):
    frame, pairs, sums, _ = panel
    one, other = (V.property_tree(frame, p, min_size=10, max_depth=2) for p in (pairs, sums))
    assert one[0].lines() == other[0].lines() and len(one[0].leaves()) > 1


@pytest.mark.parametrize("share", [0.0, 0.4, 0.7, 1.5])
def test_neighbourhood_density(panel, share):
    _, pairs, sums, rows = panel
    _same(R.neighbourhood_density(pairs, rows.select("id", "weight"), share), R.neighbourhood_density(sums, rows.select("id", "weight"), share), "id")


@pytest.mark.parametrize("criterion", ["density", "freq", "dist", "random"])
def test_representatives(panel, criterion):
    _, pairs, sums, rows = panel
    rows = rows.select("id", "weight")
    _same(R.representatives(pairs, rows, 0.6, 0.6, criterion=criterion), R.representatives(sums, rows, 0.6, 0.6, criterion=criterion), "rank")


def test_no_pairs_are_made(panel):
    _, _, sums, rows = panel
    for found in (R.medoids(sums, rows), A.distances_to_center(sums, rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "NestedLoop" not in plan


def test_one_sequence_has_no_pairs(spark):
    frame = Q.build(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "id long, pos int, s string"), "id", "pos", "s", ["a", "b"])
    rows = D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight")
    assert Mismatches(frame).largest() is None
    assert [tuple(r) for r in R.neighbourhood_density(Mismatches(frame), rows).collect()] == [(1, 1.0)]
