"""Associations by position against pairs of windows."""

import math

import numpy as np
import pytest

from trajectra.operators import positions as P
from trajectra.operators import sequences


def made(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(p), "abc"[int(rng.integers(0, 2 + (i + p) % 2))], float(1 + i % 3)) for i in range(40) for p in range(1, 7) if rng.random() < 0.95 or p == 3]
    frame = sequences.build(spark.createDataFrame(rows, "id long, pos int, s string, w double"), "id", "pos", "s", "abc", weight="w")
    return rows, frame, {i: ["x", "y", "z", None][i % 4 if i < 36 else 3] for i in range(40)}


@pytest.mark.parametrize(("before", "after"), [(0, 0), (0, 1), (1, 1)])
def test_statistics_equal_pairs(spark, before, after):
    rows, frame, group = made(spark)
    labels = spark.createDataFrame(list(group.items()), "id long, group string")
    found = {r.pos: r for r in P.association_by_position(frame, labels, before, after).collect()}
    parts = {(r.pos, r.group): r for r in P.discrepancy_by_position(frame, labels, before, after).collect()}
    at = {(i, p): s for i, p, s, _ in rows}
    for pos in range(1, 7):
        places = range(pos - before, pos + after + 1)
        ids = [i for i in range(40) if group[i] and all((i, p) in at for p in places)]
        if not ids:
            assert pos not in found
            continue
        w = np.array([1.0 + i % 3 for i in ids])
        d = np.array([[sum(at[i, p] != at[j, p] for p in places) for j in ids] for i in ids], float)
        own = {g: np.array([group[i] == g for i in ids]) for g in "xyz"}
        total, k = w.sum(), 3
        v = {g: (w[m] @ d[np.ix_(m, m)] @ w[m]) / 2 / w[m].sum() ** 2 for g, m in own.items()}
        size = {g: w[m].sum() for g, m in own.items()}
        ss, within = (w @ d @ w) / 2 / total, sum(size[g] * v[g] for g in v)
        dc = np.array([(d[n] * w * own[group[i]]).sum() / size[group[i]] - v[group[i]] for n, i in enumerate(ids)])
        mean = {g: (w * dc * m).sum() / size[g] for g, m in own.items()}
        left = sum(wi * (x - mean[group[i]]) ** 2 for i, wi, x in zip(ids, w, dc, strict=True))
        every = (w * (dc - (w * dc).sum() / total) ** 2).sum()
        pooled = sum((size[g] - 1) * v[g] for g in v) / (total - k)
        bartlett = ((total - k) * math.log(pooled) - sum((size[g] - 1) * math.log(v[g]) for g in v)) / (1 + (sum(1 / (size[g] - 1) for g in v) - 1 / (total - k)) / (3 * (k - 1)))
        r = found[pos]
        assert (r.weight, r.groups) == (total, k)
        for name, value in (("pseudo_f", (ss - within) / 2 / (within / (total - k))), ("pseudo_fbf", (ss - within) / sum((1 - size[g] / total) * v[g] for g in v)), ("pseudo_r2", 1 - within / ss), ("bartlett", bartlett), ("levene", (every - left) / 2 / (left / (total - k)))):
            assert abs(r[name] - value) < 1e-9, name
        assert abs(parts[pos, None].discrepancy - ss / total) < 1e-12 and all(abs(parts[pos, g].discrepancy - v[g]) < 1e-12 for g in v)


def test_positions_without_variation_and_empty_tables(spark):
    rows = [(i, p, "a" if p == 1 else "ab"[i % 2]) for i in range(6) for p in (1, 2)]
    frame = sequences.build(spark.createDataFrame(rows, "id long, pos int, s string"), "id", "pos", "s", "ab")
    labels = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, group int")
    found = {r.pos: r for r in P.association_by_position(frame, labels, 0, 0).collect()}
    assert found[1][3:] == (None, None, None, None, None) and found[2].pseudo_r2 is not None
    assert P.association_by_position(frame, labels.where("false")).count() == 0 and P.discrepancy_by_position(frame, labels.where("false")).count() == 0
