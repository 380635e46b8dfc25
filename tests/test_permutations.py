"""Permutation tests under each way of weights, against all ways to deal out small sets."""

import itertools
import math

import numpy as np
import pytest

from trajectra.operators import discrepancy
from trajectra.operators import permutations as P


def table(spark, seed=4, n=8):
    rng = np.random.default_rng(seed)
    x = np.r_[rng.normal(size=n // 2), rng.normal(1.2, size=n - n // 2)]
    d = np.abs(x[:, None] - x[None])
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(i + 1, n)], "i long, j long, d double")
    return d, pairs


def f_of(d, weights, labels):
    """``labels``: a group per row; weights may be 0."""
    groups = sorted(set(labels))
    total = weights.sum()
    ss = (weights @ d @ weights) / 2 / total
    within = sum((weights[m] @ d[np.ix_(m, m)] @ weights[m]) / 2 / weights[m].sum() for g in groups if (m := np.array([x == g for x in labels])).any())
    k = len(groups)
    return (ss - within) / (k - 1) / (within / (total - k))


@pytest.mark.parametrize("weights", P.WEIGHTS)
def test_p_values_equal_enumeration(spark, weights):
    d, pairs = table(spark)
    w = np.array([1.0, 2.0, 1.0, 1.0, 2.0, 1.0, 1.0, 1.0])
    labels = np.array(list("aaaabbbb"))
    rows = spark.createDataFrame([(i, float(w[i]), 5, str(labels[i])) for i in range(8)], "id long, weight double, set long, group string")
    found = P.set_tests(pairs, rows, 2_000, 3, weights).first()
    if weights == "replicate":
        owner = np.repeat(np.arange(8), w.astype(int))
        wide, size = d[np.ix_(owner, owner)], int(w[:4].sum())
        seen = f_of(wide, np.ones(len(owner)), np.repeat(labels, w.astype(int)))
        values = [f_of(wide, np.ones(len(owner)), ["a" if i in set(c) else "b" for i in range(len(owner))]) for c in itertools.combinations(range(len(owner)), size)]
    elif weights == "group":
        seen = f_of(d, w, labels)
        values = [f_of(d, w[list(o)], labels[list(o)]) for o in itertools.permutations(range(8))][::7]
    else:
        own = w if weights == "diss" else np.ones(8)
        seen = f_of(d, own, labels)
        values = [f_of(d, own, ["a" if i in c else "b" for i in range(8)]) for c in itertools.combinations(range(8), 4)]
    exact = np.mean(np.array(values) >= seen - 1e-12)
    assert abs(found.pseudo_f - seen) < 1e-9 and (found["set"], found.groups) == (5, 2)
    assert abs(found.p_value - exact) < 4 * math.sqrt(exact * (1 - exact) / 2_000) + 2e-3


def test_sets_are_apart_and_passes_add_up(spark, monkeypatch):
    d, pairs = table(spark, n=20)
    labels = ["xyz"[i % 3] for i in range(20)]
    rows = [(i, 1.0 + i % 2, i % 2, labels[i]) for i in range(18)] + [(18, 1.0, 7, "x"), (19, 1.0, 7, "x")]
    df = spark.createDataFrame(rows, "id long, weight double, set int, group string")
    whole = {r["set"]: r for r in P.set_tests(pairs, df, 40, 2).collect()}
    for s in (0, 1):
        own = np.array([i for i in range(18) if i % 2 == s])
        w = np.array([1.0 + i % 2 for i in own])
        assert abs(whole[s].pseudo_f - f_of(d[np.ix_(own, own)], w, [labels[i] for i in own])) < 1e-9 and 0 < whole[s].p_value <= 1
    assert whole[7].groups == 1 and whole[7].pseudo_f is None and whole[7].p_value is None
    monkeypatch.setattr(P, "MOST_DEALT", 20 * 3 * 7)
    several = {r["set"]: r for r in P.set_tests(pairs, df, 40, 2).collect()}
    assert all(several[s].pseudo_f == whole[s].pseudo_f for s in (0, 1)) and P.set_tests(pairs, df.where("false")).count() == 0
    with pytest.raises(ValueError):
        P.set_tests(pairs, df, 5, 1, "none at all")


def test_trees_split_only_where_it_is_significant(spark):
    rng = np.random.default_rng(8)
    n = 60
    real, noise = np.arange(n) % 2, rng.integers(0, 2, n)
    x = rng.normal(size=n) * 0.4 + 3 * real
    pairs = spark.createDataFrame([(i, j, float(abs(x[i] - x[j]))) for i in range(n) for j in range(i + 1, n)], "i long, j long, d double")
    rows = spark.createDataFrame([(i, 1.0, int(real[i]), int(noise[i])) for i in range(n)], "id long, weight double, real int, noise int")
    free, _ = discrepancy.distance_tree(pairs, rows, ["real", "noise"], min_size=3, max_depth=2, min_r2=0.0)
    tested, leaves = discrepancy.distance_tree(pairs, rows, ["real", "noise"], min_size=3, max_depth=2, min_r2=0.0, replicates=60, max_p=0.02)
    assert len(free.leaves()) == 4 and free.p_value is None
    assert tested.variable == "real" and tested.p_value <= 0.02 and len(tested.leaves()) == 2
    assert all(leaf.p_value is None or leaf.p_value > 0.02 for leaf in tested.leaves())
    assert {r.leaf for r in leaves.collect()} == {2, 3}
