"""Operators that SQL doesn't express, against plain computations on small tables."""

import itertools
import math

import numpy as np
import pytest

from trajectra.operators import clustering as C
from trajectra.operators import discrepancy as A
from trajectra.operators import distances as D
from trajectra.operators import hmm as H
from trajectra.operators import relational as L
from trajectra.operators import sequences as Q
from trajectra.operators import tables
from trajectra.operators import uncertainty as U
from trajectra.operators import validation as V


def points(spark, x):
    """Pair table and rows of points on a line."""
    n = len(x)
    pairs = spark.createDataFrame([(i, j, float(abs(x[i] - x[j]))) for i in range(n) for j in range(i + 1, n)], "i long, j long, d double")
    return pairs, spark.createDataFrame([(i, 1.0 + i % 2) for i in range(n)], "id long, weight double"), np.abs(np.subtract.outer(x, x)), np.array([1.0 + i % 2 for i in range(n)])


def frame(spark, sequences, k=3):
    rows = [(i, p, str(s)) for i, seq in enumerate(sequences) for p, s in enumerate(seq, 1)]
    return Q.build(spark.createDataFrame(rows, "id long, pos int, s string"), "id", "pos", "s", [str(s) for s in range(1, k + 1)])


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(4)
    return points(spark, np.round(np.concatenate([rng.normal(c, 1, 8) for c in (0, 10, 25)]), 3))


def five_statistics(d, w, g):
    """The five statistics by loops over groups."""
    W, names = w.sum(), sorted(set(g))
    k = len(names)
    inertia = lambda m: (w[m] @ d[np.ix_(m, m)] @ w[m]) / 2 / w[m].sum()
    ss = {c: inertia(g == c) for c in names}
    sizes = {c: w[g == c].sum() for c in names}
    v = {c: ss[c] / sizes[c] for c in names}
    total, within = inertia(np.ones(len(w), bool)), sum(ss.values())
    f = (total - within) / (k - 1) / (within / (W - k))
    fbf = (total - within) / sum((1 - sizes[c] / W) * v[c] for c in names)
    pooled = sum((sizes[c] - 1) * v[c] for c in names) / (W - k)
    bartlett = ((W - k) * math.log(pooled) - sum((sizes[c] - 1) * math.log(v[c]) for c in names)) / (1 + (sum(1 / (sizes[c] - 1) for c in names) - 1 / (W - k)) / (3 * (k - 1)))
    z = np.zeros(len(w))
    for c in names:
        m = g == c
        z[m] = d[np.ix_(m, m)] @ w[m] / sizes[c] - v[c]
    spread = sum((w[g == c] * (z[g == c] - np.average(z[g == c], weights=w[g == c])) ** 2).sum() for c in names)
    every = (w * (z - np.average(z, weights=w)) ** 2).sum()
    return {"pseudo_f": f, "pseudo_fbf": fbf, "pseudo_r2": 1 - within / total, "bartlett": bartlett, "levene": (every - spread) / (k - 1) / (spread / (W - k))}


def test_association_statistics_and_their_p_values(spark, line):
    pairs, rows, d, w = line
    grouped = rows.withColumn("group", rows.id % 3)
    found = {r.statistic: r for r in A.association_test(pairs, grouped, 30, seed=5).collect()}
    want = five_statistics(d, w, np.arange(len(w)) % 3)
    order = np.array([r.id for r in rows.selectExpr("id", "xxhash64(id) AS h").orderBy("h", "id").collect()])
    g, n = order % 3, len(order)
    drawn = [five_statistics(d[np.ix_(order, order)], w[order], g[(a * np.arange(n) + b) % n]) for a, b in [(1, 0), *tables.shuffles(n, 30, 5)]]
    for name, value in want.items():
        assert found[name].value == pytest.approx(value, rel=1e-9)
        assert found[name].p_value == pytest.approx(np.mean([x[name] >= value - 1e-12 for x in drawn]), abs=1e-9)


def test_running_sums_and_numbers(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(500).tolist()
    rows = spark.createDataFrame([(v, float(v % 7)) for v in values], "v int, w double").repartition(7)
    found = {r.v: (r.n, r.s) for r in tables.running(tables.numbered(rows, ["v"]), ["v"], {"s": "w"}).collect()}
    total = 0.0
    for v in range(500):
        total += v % 7
        assert found[v] == (v, pytest.approx(total))
    assert tables.running(rows.where("false"), ["v"], {"s": "w"}).count() == 0


def test_average_linkage_against_loops(spark, line):
    pairs, rows, d, w = line
    merges = C.linkage_steps(d.copy(), w, "average")
    groups, heights = [[i] for i in range(len(w))], []
    while len(groups) > 1:
        apart = lambda a, b: np.average([np.average(d[i, b], weights=w[b]) for i in a], weights=w[a])
        best = min(((apart(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)), key=lambda t: t[0])
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    assert sorted(float(m[2]) for m in merges) == pytest.approx(sorted(heights), rel=1e-9)


def test_k_medoids_reach_the_best_medoids(spark, line):
    pairs, rows, d, w = line
    found = {r.id: r.medoid for r in C.k_medoids(pairs, rows, 3).collect()}
    cost = lambda m: float(w @ d[:, list(m)].min(axis=1))
    assert cost(set(found.values())) == pytest.approx(min(cost(m) for m in itertools.combinations(range(len(w)), 3)))
    assert all(d[i, m] == d[i, sorted(set(found.values()))].min() for i, m in found.items())


@pytest.mark.parametrize("kind", ["FCMdd", "NCdd", "HNCdd", "PCMdd"])
def test_fuzzy_memberships_are_fixed_points(line, kind):
    _, _, d, w = line
    eta = np.array([1.0, 2.0, 3.0]) if kind == "PCMdd" else None
    medoids, u = C.fuzzy_partition(d, w, 3, kind, 1.5, 4.0 if kind in ("NCdd", "HNCdd") else None, eta)
    to = d[:, medoids] if kind in ("FCMdd", "PCMdd") else np.column_stack([d[:, medoids], np.full(len(w), 4.0)])
    if kind == "PCMdd":
        want = 1 / (1 + (to / eta) ** 2)
    elif kind == "HNCdd":
        want = (to == to.min(axis=1, keepdims=True)).astype(float)
    else:
        want = np.maximum(to, 1e-12) ** -2.0
        want /= want.sum(axis=1, keepdims=True)
    assert np.abs(u - want).max() < 1e-5
    taken = []
    for m, own in enumerate(medoids):
        cost = d @ (w * u[:, m] ** 1.5)
        cost[taken] = np.inf
        assert cost[own] == pytest.approx(cost.min())
        taken.append(own)


def test_clara_objectives_against_loops(spark):
    rng = np.random.default_rng(3)
    f = frame(spark, [rng.choice([1, 2, 3], 6, p=np.roll([0.8, 0.1, 0.1], i % 3)).tolist() for i in range(60)])
    how = D.measure(f, "HAM")
    labels, report = C.clara(f, how, 3, samples=2, size=1_000, objective="ams", stability=True)
    unique = D.unique_sequences(f).orderBy("uid").collect()
    block = how.block([list(r.seq) for r in unique])
    d, w = how.distances(block, block), np.array([r.weight for r in unique])
    medoids = C.partition_medoids(d, w, 3)
    to = d[:, medoids]
    at, two = to.argmin(axis=1), np.sort(to, axis=1)
    mean = np.average(two[:, 0], weights=w)
    radius = np.array([np.average(to[at == c, c], weights=w[at == c]) for c in range(3)])
    apart = d[np.ix_(medoids, medoids)]
    off = apart + np.diag([np.inf] * 3)
    want = {
        "distance": mean, "db": np.mean([max((radius[a] + radius[b]) / apart[a, b] for b in range(3) if b != a) for a in range(3)]), "xb": mean / off.min(),
        "pbm": (apart.max() / mean / 3) ** 2, "ams": np.average((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-300), weights=w),
    }
    for row in report.collect():  # a sample of everything is the same each time
        assert (row.ari, row.jaccard) == (1.0, 1.0)
        for name, value in want.items():
            assert row[name] == pytest.approx(value, rel=1e-9), name
    by_seq = {tuple(r.seq): c + 1 for r, c in zip(unique, at.tolist(), strict=True)}
    seqs = {r.id: tuple(r.seq) for r in f.arrays.collect()}
    assert {r.id: r.cluster for r in labels.collect()} == {i: by_seq[q] for i, q in seqs.items()}


def test_likelihoods_against_all_paths_and_fits_that_climb(spark):
    model = H.random_model(2, [3], seed=7)
    seq = [1, 3, 2, 2]
    total, best = 0.0, (0.0, None)
    for path in itertools.product(range(2), repeat=4):
        p = model.start[path[0]] * model.emissions[0][path[0], seq[0] - 1]
        for t in range(1, 4):
            p *= model.moves[path[t - 1], path[t]] * model.emissions[0][path[t], seq[t] - 1]
        total, best = total + p, max(best, (p, path))
    assert H.forward_backward(model, [seq])[0] == pytest.approx(math.log(total))
    assert [s - 1 for s in H.viterbi(model, [seq])[0]] == list(best[1])
    many = H.forward_backward_many(model, [np.array([seq, seq[::-1]])])
    one = [H.forward_backward(model, [q]) for q in (seq, seq[::-1])]
    for n in range(2):
        assert many[0][n] == pytest.approx(one[n][0]) and np.allclose(many[1][n], one[n][1]) and np.allclose(many[2][n], one[n][2])
    rng = np.random.default_rng(1)
    f = frame(spark, [rng.integers(1, 4, int(n)).tolist() for n in rng.integers(1, 9, 40)])
    _, history = H.fit([f], 2, rounds=12)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(history))
    _, history, _ = H.fit_best([f], 2, restarts=3, rounds=6)
    assert history[-1] >= H.fit([f], 2, rounds=6)[1][-1] - 1e-9


def test_bootstrapped_models_stay_near_the_model(spark):
    model = H.HMM(np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.2, 0.8]]), (np.array([[0.9, 0.05, 0.05], [0.05, 0.15, 0.8]]),))
    rows = H.simulate(spark, model, 150, 12, seed=3).collect()
    f = frame(spark, [list(r.q0) for r in rows])
    found = {(r.parameter, r.from_state, r.to): r for r in H.bootstrap(f, model, 6).collect()}
    assert len(found) == 2 + 4 + 6 and abs(found["move", 1, 1].mean - 0.9) < 0.05 and abs(found["emission", 2, 3].mean - 0.8) < 0.07
    mixed = H.simulate_mixture(spark, [model, model], [0.25, 0.75], 400, 3).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in mixed}[2] == pytest.approx(300, abs=40)


def test_alignment_steps(spark):
    f = frame(spark, [[1, 2, 3, 1], [2, 3, 3], [1]])
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "i long, j long")
    steps = [tuple(r) for r in Q.alignments(f, pairs, [[0, 1.5, 1.5], [1.5, 0, 1.5], [1.5, 1.5, 0]], 1.0).orderBy("i", "j", "step").collect()]
    assert [s[3] for s in steps if s[1] == 1] == ["delete", "match", "match", "substitute"] and [s[3] for s in steps if s[1] == 2] == ["delete", "delete", "delete", "match"]
    assert [(r.j, r.prefix, r.subsequence) for r in Q.common_lengths(f, pairs).orderBy("j").collect()] == [(1, 0, 2), (2, 1, 1)]


def test_pseudoclass_regression_of_sure_classes_is_least_squares(spark):
    rng = np.random.default_rng(2)
    c, x = rng.integers(1, 4, 90), rng.normal(0, 1, 90)
    y = 1.0 + (c == 2) * 2.0 - (c == 3) * 1.5 + 0.5 * x + rng.normal(0, 0.3, 90)
    memberships = spark.createDataFrame([(i, k, float(k == c[i])) for i in range(90) for k in (1, 2, 3)], "id long, cluster int, u double")
    rows = spark.createDataFrame([(i, float(y[i]), float(x[i])) for i in range(90)], "id long, y double, x double")
    found = {r.term: r for r in V.pseudoclass_ols(memberships, rows, "y", ["x"], draws=4).collect()}
    z = np.column_stack([np.ones(90), c == 2, c == 3, x]).astype(float)
    beta, rest, *_ = np.linalg.lstsq(z, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * rest[0] / 86)
    for name, b, s in zip(("constant", "cluster_2", "cluster_3", "x"), beta, se, strict=True):
        assert found[name].coefficient == pytest.approx(b, abs=1e-8) and found[name].se == pytest.approx(s, rel=1e-6)


def test_beta_regression_finds_what_made_the_shares(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, 1_500)
    mu = 1 / (1 + np.exp(-(-0.5 + 0.8 * x)))
    u = rng.beta(mu * 12, (1 - mu) * 12)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(u, x, strict=True)], "u double, x int")
    found = {r.term: r.coefficient for r in V.beta_regression(rows, "u", ["x"]).collect()}
    assert found["constant"] == pytest.approx(-0.5, abs=0.08) and found["x"] == pytest.approx(0.8, abs=0.06) and found["log_precision"] == pytest.approx(math.log(12), abs=0.12)


def test_typology_effects_are_differences_of_shares(spark, line):
    pairs, rows, d, w = line
    covered = rows.selectExpr("id", "weight", "CAST(id >= 16 OR id % 4 = 0 AS DOUBLE) AS x")
    x = np.array([float(i >= 16 or i % 4 == 0) for i in range(24)])
    at = d[:, C.partition_medoids(d, w, 3)].argmin(axis=1)
    for row in V.typology_effects(pairs, covered, "x", 3, replicates=3).collect():
        inside = at == row.cluster - 1
        want = np.average(inside[x == 1], weights=w[x == 1]) - np.average(inside[x == 0], weights=w[x == 0])
        assert row.effect == pytest.approx(want, abs=2e-3) and row.mean == pytest.approx(want, abs=0.4)


def test_replicates_against_pairs_of_arrays(spark):
    rng = np.random.default_rng(8)
    f = frame(spark, [np.repeat(rng.integers(1, 4, 4), 3).tolist() for _ in range(12)])
    rows = U.replicates(f, 4, U.error_distribution(1.0, 2))
    held: dict = {}
    for r in rows.collect():
        held.setdefault(r.id, {})[r.rep] = list(r.seq)
    gap = lambda i, j, r: float(sum(a != b for a, b in zip(held[i][r], held[j][r], strict=True)))
    for row in U.distance_spread(rows).collect():
        drawn = [gap(row.i, row.j, r) for r in range(1, 5)]
        assert row.observed == gap(row.i, row.j, 0) and row.mean == pytest.approx(np.mean(drawn)) and row.sd == pytest.approx(np.std(drawn, ddof=1))
        assert row.bias == pytest.approx(np.mean(drawn) - row.observed) and row.mse == pytest.approx(np.mean([(x - row.observed) ** 2 for x in drawn]))
    pairs = list(itertools.combinations(sorted(held), 2))
    for row in U.replicate_correlation(rows).collect():
        assert row.r == pytest.approx(np.corrcoef([gap(i, j, row.rep) for i, j in pairs], [gap(i, j, 0) for i, j in pairs])[0, 1])
    assert all(-1 <= r.ari <= 1 and 0 <= r.jaccard <= 1 for r in U.replicate_agreement(rows, 3).collect())


def test_level_tests_agree_with_factors(spark, line):
    pairs, _, d, _ = line
    units = spark.createDataFrame([(i, f"a{i % 3}", f"b{i // 8}") for i in range(24)], "id long, level_1 string, level_2 string")
    found = {(r.level, r.statistic): r.value for r in L.level_test(pairs, units, 5).collect()}
    one = np.ones(24)
    assert found["level_2", "pseudo_r2"] == pytest.approx(five_statistics(d, one, np.arange(24) // 8)["pseudo_r2"])
    assert found["level_1", "pseudo_f"] == pytest.approx(five_statistics(d, one, np.arange(24) % 3)["pseudo_f"])


def test_pairs_beyond_the_limit_say_so(spark):
    f = frame(spark, [[1, 2], [2, 1], [3, 3]])
    with pytest.raises(ValueError, match="pairs"):
        D.pairwise(f, "HAM", most=2)
    with pytest.raises(ValueError, match="pairs"):
        D.expand(f, D.pairwise(f, "HAM"), most=2)


def test_stored_tables_are_read_until_released(spark):
    held = tables.stored(spark.range(5))
    assert tables.stored(held) is held and held.count() == 5
