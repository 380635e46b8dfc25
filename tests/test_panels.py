"""Operators on panels without a pair table or a matrix give what they give on pair tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.operators import clustering as C
from trajectra.operators import distances as D
from trajectra.operators import events as E
from trajectra.operators import multidomain as M
from trajectra.operators import representatives as R
from trajectra.operators import uncertainty as U
from trajectra.operators import validation as V
from trajectra.operators.mismatches import Mismatches
from trajectra.operators.sequences import build


def panel(spark, n=40, length=8, k=3, seed=1, equal=True):
    """A panel in which some rows are equal, its pair table, and the distinct rows with weights."""
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, k, (n, length))
    codes[n // 2 :] = np.where(rng.random((n - n // 2, length)) < 0.3, codes[n // 2 :], codes[: n - n // 2])
    if equal:
        codes[-1] = codes[0]
    rows = [(i, t, "abcdef"[c]) for i, s in enumerate(codes.tolist()) for t, c in enumerate(s, 1)]
    frame = build(spark.createDataFrame(rows, "id long, pos int, state string"), "id", "pos", "state", list("abcdef"[:k]))
    return frame, D.pairwise(frame, "HAM"), D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight")


def no_pairs(monkeypatch):
    """Make the pair table an error."""

    def fail(*args, **options):
        raise AssertionError("a pair table was made")

    monkeypatch.setattr(Mismatches, "pairs", fail)


def test_merged_groups_need_no_pair_table(spark, monkeypatch):
    frame, pairs, rows = panel(spark)
    rows = rows.withColumn("group", F.col("id") % 5)
    expected = sorted(map(tuple, V.merge_groups(pairs, rows, 3).collect()))
    no_pairs(monkeypatch)
    assert sorted(map(tuple, V.merge_groups(Mismatches(frame), rows, 3).collect())) == expected


def test_fuzzy_indices_need_no_pair_table(spark, monkeypatch):
    frame, pairs, rows = panel(spark)
    grouped = rows.withColumn("group", (F.col("id") % 3).cast("int"))
    medoids = R.medoids(pairs, grouped).select(F.col("group").alias("cluster"), "medoid")
    u = F.when(F.col("group") == F.col("cluster"), 0.6).otherwise(0.2)
    memberships = grouped.select("id", "group", F.explode(F.array(*map(F.lit, range(3)))).alias("cluster")).select("id", "cluster", u.alias("u"))
    expected = C.fuzzy_indices(pairs, memberships, medoids, rows).first()
    no_pairs(monkeypatch)
    assert C.fuzzy_indices(Mismatches(frame), memberships, medoids, rows).first() == pytest.approx(expected)


def test_leave_one_out_needs_no_pair_table(spark):
    one, two = panel(spark, k=3)[0], panel(spark, k=4, seed=2)[0]
    rows = D.unique_sequences(one).select(F.col("uid").alias("id"), "weight")
    ids = rows.select("id")
    tables = [D.expand(f, D.pairwise(f, "HAM")).join(ids.withColumnRenamed("id", "i"), "i").join(ids.withColumnRenamed("id", "j"), "j") for f in (one, two)]
    expected = sorted(map(tuple, M.leave_one_out(tables, rows, 2).collect()))
    found = sorted(map(tuple, M.leave_one_out([Mismatches(one), Mismatches(two)], rows, 2).collect()))
    assert np.allclose(found, expected)


def test_mining_deals_out_what_its_files_make_look_small(spark):
    rows = spark.createDataFrame([(i, float(t), "abc"[(i + t) % 3]) for i in range(30) for t in range(4)], "id long, ts double, event string")
    ends, _ = E._keep_frequent(E.stored(rows.select(F.array(F.array("event")).alias("pattern"), "id", F.col("ts").alias("first"), F.col("ts").alias("last"))), rows.select("id").distinct().withColumn("weight", F.lit(1.0)), 1, E.Constraint())
    plan = ends.join(rows.withColumnRenamed("ts", "t"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert E.frequent_subsequences(rows, 30).where("length = 4").count() == 0


def test_typology_effects_need_no_matrix(spark):
    frame, pairs, rows = panel(spark)
    rows = rows.withColumn("x", F.col("id") % 2)
    expected = sorted(map(tuple, V.typology_effects(pairs, rows, "x", 3, replicates=3).collect()))
    found = sorted(map(tuple, V.typology_effects(Mismatches(frame), rows, "x", 3, replicates=3, most=5).collect()))
    assert np.allclose(found, expected)


def test_replicates_agree_as_by_loops(spark):
    rng = np.random.default_rng(3)
    seqs = rng.integers(1, 4, (30, 10))
    reps = [seqs, np.where(rng.random(seqs.shape) < 0.2, 1, seqs)]
    rows = spark.createDataFrame([(r, i, s) for r, x in enumerate(reps) for i, s in enumerate(x.tolist())], "rep int, id long, seq array<int>")
    labels = []
    for x in reps:
        d = (x[:, None] != x[None]).sum(axis=2).astype(float)
        labels.append(d[:, C.partition_medoids(d, np.ones(len(x)), 3)].argmin(axis=1))
    counts: dict = {}
    for key in zip(labels[1].tolist(), labels[0].tolist(), strict=True):
        counts[key] = counts.get(key, 0.0) + 1.0
    (found,) = U.replicate_agreement(rows, 3).collect()
    assert (found.rep, found.ari, found.jaccard) == pytest.approx((1, *C._agreement_of(counts)))


def test_presence_is_that_of_counts_and_its_plan_does_not_grow(spark):
    rows = spark.createDataFrame([(i, float(t), "abc"[(i * t + t) % 3]) for i in range(12) for t in range(5)], "id long, ts double, event string")
    patterns = [["a"], ["b"], ["a", "b"], ["a", "a", "c"], ["c", "b", "a"], ["b", "a"]]
    expected = sorted(map(tuple, E.count_occurrences(rows, patterns, presence=True).collect()))
    assert sorted(map(tuple, E.presence(rows, patterns).collect())) == expected
    many = [list(p) for p in sorted({"abc"[a] + "abc"[b] + "abc"[c] for a in range(3) for b in range(3) for c in range(3)})]
    short, long = (len(E.presence(rows, p)._jdf.queryExecution().optimizedPlan().toString()) for p in (many[:2], many))
    assert long < short + 100


def alike(found, expected):
    """Whether rows are the same, in any order, numbers nearly so."""
    a, b = (sorted(map(tuple, t.collect()), key=str) for t in (found, expected))
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("equal", [False, True])
def test_quality_needs_no_pair_table(spark, monkeypatch, equal):
    frame, pairs, rows = panel(spark, equal=equal)
    pairs = C.stored(pairs)
    labels = C.stored(C.cluster_labels(pairs, rows, [3]).join(rows, "id").select("id", "cluster", "weight"))
    expected = [C.partition_quality(pairs, labels), C.cluster_range(pairs, rows, [2, 3]), C.compare_methods(pairs, rows, ["average", "PAM"], [2, 3])]
    no_pairs(monkeypatch)
    gaps = Mismatches(frame)
    found = [C.partition_quality(gaps, labels), C.cluster_range(gaps, rows, [2, 3]), C.compare_methods(gaps, rows, ["average", "PAM"], [2, 3])]
    for f, e in zip(found, expected, strict=True):
        assert f.dtypes == e.dtypes
        alike(f, e)


@pytest.mark.parametrize("method", ["average", "ward"])
@pytest.mark.parametrize("equal", [False, True])
def test_linkage_by_rounds_is_that_of_a_matrix(spark, monkeypatch, method, equal):
    frame, pairs, rows = panel(spark, n=60, length=24, k=5, equal=equal)
    expected = C.hierarchical(pairs, rows, method).orderBy("step").toPandas()
    no_pairs(monkeypatch)
    for most in (100, 10):
        monkeypatch.setattr(C, "MOST_DENSE", most)
        found = C.hierarchical(Mismatches(frame), rows, method)
        assert [c for c, _ in found.dtypes] == ["step", "left", "right", "height", "size"]
        got = found.orderBy("step").toPandas()
        assert (got.step == expected.step).all() and np.allclose(np.sort(got.height), np.sort(expected.height))
        assert sorted(got.left.tolist() + got.right.tolist()) == sorted(expected.left.tolist() + expected.right.tolist())
        assert got["size"].iloc[-1] == expected["size"].iloc[-1] and (got.left < got.right).all() and (got.right < len(got) + 1 + got.step).all()
        if method == "ward":
            assert (got.left == expected.left).all() and (got.right == expected.right).all()


def test_divisive_merges_have_the_sizes_of_their_parts():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (40, 8))
    d, n = (x[:, None] != x[None]).sum(axis=2).astype(float), 40
    steps = C.divisive_steps(d, np.ones(n))
    size = [1.0] * n
    for left, right, _, total in steps:
        size.append(size[int(left)] + size[int(right)])
        assert size[-1] == total


def test_divisive_labels_need_no_matrix(spark, monkeypatch):
    frame, pairs, rows = panel(spark, n=50)
    expected = C.cluster_labels(pairs, rows, [2, 3, 5], "diana")
    no_pairs(monkeypatch)
    alike(C.cluster_labels(Mismatches(frame), rows, [2, 3, 5], "diana"), expected)


def test_fuzzy_analysis_needs_no_matrix(spark, monkeypatch):
    frame, pairs, rows = panel(spark)
    expected = C.fuzzy_analysis(pairs, rows, 3, rounds=6)
    no_pairs(monkeypatch)
    alike(C.fuzzy_analysis(Mismatches(frame), rows, 3, rounds=6), expected)
