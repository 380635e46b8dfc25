"""Validation operators on cases with known answers."""

import numpy as np
import pytest

from trajectra.operators import validation as V


def table(spark, points, groups):
    rows = spark.createDataFrame([(i, 1.0, g) for i, g in enumerate(groups)], "id long, weight double, group string")
    pairs = spark.createDataFrame([(i, j, float((points[i] - points[j]) ** 2)) for i in range(len(points)) for j in range(i + 1, len(points))], "i long, j long, d double")
    return pairs, rows


def test_squared_distances_give_the_usual_analysis_of_variance(spark):
    x = [1.0, 2.0, 4.0, 9.0, 11.0, 12.0]
    pairs, rows = table(spark, x, "aaabbb")
    found = {r.term: r for r in V.multifactor_association(pairs, rows, ["group"]).collect()}
    a, b = np.array(x[:3]), np.array(x[3:])
    total = ((np.array(x) - np.mean(x)) ** 2).sum()
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert found["group"].pseudo_r2 == pytest.approx(1 - within / total)
    assert found["group"].pseudo_f == pytest.approx((total - within) / (within / 4))


def test_nearest_groups_merge_first(spark):
    pairs, rows = table(spark, [0.0, 0.1, 1.0, 1.1, 9.0, 9.1], "aabbcc")
    assert {tuple(r) for r in V.merge_groups(pairs, rows, 2).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_digamma():
    assert V.digamma(np.array([1.0, 2.0, 10.5])) == pytest.approx([-0.5772156649015329, 0.42278433509846713, 2.3030010343500866])


def test_dirichlet_regression_finds_the_parameters(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a = np.exp([1.0 + 0.8 * (i % 2), 0.5])
        s = rng.dirichlet(a)
        rows.append((float(s[0]), float(s[1]), float(i % 2)))
    found = {(r.share, r.term): r.coefficient for r in V.dirichlet_regression(spark.createDataFrame(rows, "a double, b double, x double"), ["a", "b"], ["x"]).collect()}
    assert found["a", "constant"] == pytest.approx(1.0, abs=0.25) and found["a", "x"] - found["b", "x"] == pytest.approx(0.8, abs=0.25)


def test_clear_clusters_win_the_bootstrap(spark):
    pairs, rows = table(spark, [0.0, 0.1, 0.2, 9.0, 9.1, 9.2, 0.3, 9.3], "aaaaaaaa")
    means = {k: [] for k in (2, 3)}
    for r in V.bootstrap_range(pairs, rows, [2, 3], replicates=5).collect():
        means[r.k].append(r.asw)
    assert np.mean(means[2]) > np.mean(means[3])
