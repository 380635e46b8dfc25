"""Medoids, associations and bootstraps of panels without a matrix, against those with one, beyond the matrix's limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.operators import clustering as C
from trajectra.operators import distances as D
from trajectra.operators import sequences as Q
from trajectra.operators import validation as V
from trajectra.operators.mismatches import Mismatches


@pytest.fixture
def panel(spark):
    """(frame, rows, distances, weights) of 230 sequences, which are in several blocks, of weights 1 to 5."""
    rng = np.random.default_rng(3)
    kinds = ["aaabbbccc", "cccaaabbb", "bcbcbcaaa"]
    sequences = sorted({"".join(c if rng.random() < 0.7 else "abcd"[rng.integers(4)] for c in kinds[n % 3]) for n in range(260)})[:230]
    rows = [(7 * i + 3, p, s) for i, seq in enumerate(sequences) for p, s in enumerate(seq, 1)]
    frame = Q.build(spark.createDataFrame(rows, "id long, pos int, s string"), "id", "pos", "s", list("abcd"))
    x = np.array([list(s) for s in sequences])
    weighted = D.unique_sequences(frame).select(F.col("uid").alias("id"), (F.col("uid") % 5 + 1).cast("double").alias("weight"))
    w = np.array([(7 * i + 3) % 5 + 1.0 for i in range(len(x))])
    return frame, weighted, (x[:, None] != x[None]).sum(axis=2).astype(float), w


@pytest.fixture
def few(monkeypatch):
    """One matrix is for 50 rows at most."""
    monkeypatch.setattr(C.in_one_group, "__defaults__", (50,))


def test_medoids_of_more_rows_than_a_matrix_takes(panel, few):
    frame, rows, d, w = panel
    with pytest.raises(ValueError):
        C.k_medoids(D.pairwise(frame, "HAM"), rows, 3)
    for k in (1, 3, 4):
        chosen = C.partition_medoids(d, w, k)
        found = C.k_medoids(Mismatches(frame), rows, k).orderBy("id").collect()
        assert [r.medoid for r in found] == [7 * int(m) + 3 for m in chosen[d[:, chosen].argmin(axis=1)]]
        assert [r.cluster for r in found] == (d[:, chosen].argmin(axis=1) + 1).tolist()


@pytest.mark.parametrize(("kind", "noise"), [("FCMdd", None), ("NCdd", 4.0), ("HNCdd", 4.0), ("PCMdd", None)])
def test_fuzzy_medoids_of_more_rows_than_a_matrix_takes(panel, few, kind, noise):
    frame, rows, d, w = panel
    _, u = C.fuzzy_partition(d, w, 3, kind, 1.5, noise)
    found = C.fuzzy_medoids(Mismatches(frame), rows, 3, noise=noise, kind=kind).collect()
    names = [1, 2, 3, 0]
    assert len(found) == u.size
    assert all(abs(r.u - u[(r.id - 3) // 7, names.index(r.cluster)]) < 1e-9 for r in found)


def test_bootstraps_without_a_matrix_equal_those_with_one(panel):
    frame, rows, *_ = panel
    one, other = (sorted(tuple(r) for r in V.bootstrap_range(p, rows, [2, 3], replicates=3).collect()) for p in (D.pairwise(frame, "HAM"), Mismatches(frame)))
    assert len(one) == 6 and np.allclose(one, other, atol=1e-9)
    assert V.bootstrap_range(Mismatches(frame), rows, [2], replicates=1, most=10).count() == 1


def test_association_by_sums_equals_the_projection_of_the_matrix(panel):
    frame, rows, d, w = panel
    ids = np.arange(len(w)) * 7 + 3
    g, h = ids % 3, ids % 2
    m = d @ w / w.sum()
    centred = -0.5 * (d - m[:, None] - m[None] + (w @ m) / w.sum())
    s = np.sqrt(w)

    def explained(*columns):
        x = np.stack([np.ones(len(w)), *[(c == v).astype(float) for c in columns for v in sorted(set(c))[1:]]], axis=1)
        q = np.linalg.qr(x * s[:, None])[0]
        return np.trace(q.T @ (centred * s[:, None] * s[None]) @ q)

    total, both = (w * np.diag(centred)).sum(), explained(g, h)
    wanted = {"g": (both - explained(h)) / total, "h": (both - explained(g)) / total, "total": both / total}
    for pairs in (Mismatches(frame), D.pairwise(frame, "HAM")):
        found = {r.term: r for r in V.multifactor_association(pairs, rows.withColumns({"g": F.col("id") % 3, "h": F.col("id") % 2}), ["g", "h"]).collect()}
        assert all(abs(found[t].pseudo_r2 - v) < 1e-9 for t, v in wanted.items())
        assert abs(found["h"].pseudo_f - (both - explained(g)) / ((total - both) / (w.sum() - 4))) < 1e-9


def test_association_of_one_combination_in_each_row(spark):
    # A factor that follows from another adds nothing, though there are fewer combinations than columns.
    rows = spark.createDataFrame([(i, 1.0, i % 3, i % 3) for i in range(9)], "id long, weight double, g int, h int")
    pairs = spark.createDataFrame([(i, j, float((i * i - j * j) ** 2)) for i in range(9) for j in range(i + 1, 9)], "i long, j long, d double")
    found = {r.term: r.pseudo_r2 for r in V.multifactor_association(pairs, rows, ["g", "h"]).collect()}
    assert found["g"] == pytest.approx(0, abs=1e-9) and found["h"] == pytest.approx(0, abs=1e-9)
    assert found["total"] == pytest.approx({r.term: r.pseudo_r2 for r in V.multifactor_association(pairs, rows, ["g"]).collect()}["total"])
