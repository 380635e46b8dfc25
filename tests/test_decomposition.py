"""Cluster decompositions against regressions in numpy."""

import numpy as np
import pytest

from trajectra.operators import decomposition as D


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 600
    group, cluster, x = rng.integers(0, 2, n), rng.integers(0, 4, n), rng.normal(size=n)
    cluster[(group == 0) & (rng.random(n) < 0.5)] = 1
    y = 2.0 + group + 0.5 * cluster + x * (1 + group) + rng.normal(size=n)
    return [(i, int(g), "abcd"[c], float(v), float(t)) for i, (g, c, v, t) in enumerate(zip(group, cluster, x, y, strict=True))]


def table(spark, rows):
    return spark.createDataFrame([*rows, (9_000, None, "a", 1.0, 1.0), (9_001, 1, None, 1.0, 1.0), (9_002, 0, "a", 1.0, None)], "id long, g int, c string, x double, y double")


def plain(rows, base, owned):
    """The parts by dummies against ``base``; ``owned``: cluster to the group whose coefficient it takes."""
    fits = {}
    for g in (0, 1):
        part = [r for r in rows if r[1] == g]
        design = np.array([[1.0, r[3], *(float(r[2] == c) for c in "abcd" if c != base)] for r in part])
        beta = np.linalg.solve(design.T @ design, design.T @ np.array([r[4] for r in part]))
        by = dict(zip([c for c in "abcd" if c != base], beta[2:], strict=True)) | {base: 0.0}
        mean = np.mean(list(by.values()))
        fits[g] = beta[0] + mean, beta[1], {c: b - mean for c, b in by.items()}, np.mean([r[3] for r in part]), {c: np.mean([r[2] == c for r in part]) for c in "abcd"}, np.mean([r[4] for r in part])
    (a0, b0, m0, x0, p0, y0), (a1, b1, m1, x1, p1, y1) = fits[0], fits[1]
    star = {c: (m0, m1)[owned[c]][c] for c in "abcd"}
    out = {("gap", None): y0 - y1, ("constant", None): a0 - a1, ("explained", "x"): (x0 - x1) * b0, ("returns", "x"): x1 * (b0 - b1)}
    for c in "abcd":
        out["explained", f"c={c}"] = (p0[c] - p1[c]) * star[c]
        out["returns", f"c={c}"] = p0[c] * (m0[c] - star[c]) + p1[c] * (star[c] - m1[c])
    for k in ("explained", "returns"):
        out[k, None] = sum(v for (kind, term), v in out.items() if kind == k and term)
    return out


def test_parts_equal_regressions_against_any_base_and_add_up(spark, rows):
    df = table(spark, rows)
    shares = {r.cluster: (r.share0, r.share1) for r in D.cluster_owners(df, "g", "c").collect()}
    owned = D.owners(shares, 30.0)
    found = {(r.component, r.term): r.value for r in D.cluster_decomposition(df, "y", "g", "c", ["x"], threshold=30.0).collect()}
    assert set(owned.values()) == {0, 1}
    for base in "abcd":
        expected = plain(rows, base, owned)
        assert set(found) == set(expected) and all(abs(found[k] - v) < 1e-8 for k, v in expected.items())
    assert abs(found["gap", None] - sum(found[k, None] for k in ("constant", "explained", "returns"))) < 1e-9
    for by, fixed in (("group0", 0), ("group1", 1)):
        found = {(r.component, r.term): r.value for r in D.cluster_decomposition(df, "y", "g", "c", ["x"], clusters_by=by).collect()}
        assert all(abs(found[k] - v) < 1e-8 for k, v in plain(rows, "b", dict.fromkeys("abcd", fixed)).items())
    pooled = {(r.component, r.term): r.value for r in D.cluster_decomposition(df, "y", "g", "c", ["x"], clusters_by="pooled", weight="id").collect()}
    assert abs(pooled["gap", None] - sum(pooled[k, None] for k in ("constant", "explained", "returns"))) < 1e-8


def test_bootstrap_is_seeded_and_near_the_parts(spark, rows):
    df = table(spark, rows)
    one = {(r.component, r.term): r for r in D.bootstrap_cluster_decomposition(df, "y", "g", "c", "id", ["x"], replicates=60, seed=3).collect()}
    again = {(r.component, r.term): r for r in D.bootstrap_cluster_decomposition(df.repartition(7), "y", "g", "c", "id", ["x"], replicates=60, seed=3).collect()}
    assert all(abs(one[k].mean - again[k].mean) < 1e-9 and abs(one[k].se - again[k].se) < 1e-9 for k in one)
    value = {(r.component, r.term): r.value for r in D.cluster_decomposition(df, "y", "g", "c", ["x"]).collect()}
    assert set(one) == set(value) and all(abs(one[k].mean - v) < one[k].se for k, v in value.items())
    y = {g: np.array([r[4] for r in rows if r[1] == g]) for g in (0, 1)}
    assert 0.7 < one["gap", None].se / np.sqrt(sum(v.var() / len(v) for v in y.values())) < 1.4


def test_owners_and_errors(spark, rows):
    assert D.owners({"a": (0.4, 0.1), "b": (0.1, 0.4), "c": (0.3, 0.3), "d": (0.0, 0.0)}, 50, None, {"c": 1, "z": 0}) == {"a": 0, "b": 1, "c": 1, "d": None}
    df = table(spark, rows)
    for bad in (df.where("c = 'a'"), df.where("g = 0"), df.where("false")):
        with pytest.raises(ValueError):
            D.cluster_decomposition(bad, "y", "g", "c")
    with pytest.raises(ValueError):
        D.cluster_decomposition(df, "y", "g", "c", clusters_by="none")
