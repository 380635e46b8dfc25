"""Sums of domain measures without a pair table, and representativeness, against loops."""

import itertools

import numpy as np
import pytest

from trajectra.operators import clustering as C
from trajectra.operators import distances as D
from trajectra.operators import multidomain as M
from trajectra.operators import sequences


def frame_of(spark, seqs):
    rows = [(i, p, "abc"[s]) for i, seq in seqs.items() for p, s in enumerate(seq, 1)]
    return sequences.build(spark.createDataFrame(rows, "id long, pos int, s string"), "id", "pos", "s", "abc")


@pytest.fixture(scope="module")
def domains(spark):
    rng = np.random.default_rng(2)
    one = {i: rng.integers(0, 3, rng.integers(2, 7)).tolist() for i in range(40)}
    two = {i: rng.integers(0, 3, rng.integers(1, 9)).tolist() for i in range(3, 40)}
    one[7], two[7] = one[5], two[5]
    return frame_of(spark, one), frame_of(spark, two)


OPTIONS = [{"method": "OM", "indel": 1.0}, {"method": "LCP"}]


@pytest.mark.parametrize("link", ["sum", "mean"])
def test_distances_to_references_equal_the_pair_table(spark, domains, link):
    frame, how = M.summed(domains, OPTIONS, [1.0, 3.0], link)
    uids = {r.uid: list(r.seq) for r in D.unique_sequences(frame).collect()}
    assert 7 not in uids and 5 in uids and not uids.keys() & {0, 1, 2}
    pairs = {(r.i, r.j): r.d for r in M.summed_distances(domains, OPTIONS, [1.0, 3.0], link).collect()}
    chosen = sorted(uids)[:6]
    found = {(r.i, chosen[r.ref]): r.d for r in D.to_references(frame, [uids[u] for u in chosen], how).collect()}
    assert len(found) == 6 * len(uids)
    for (i, j), d in found.items():
        assert abs(d - (0.0 if i == j else pairs[min(i, j), max(i, j)])) < 1e-9


def test_clara_of_summed_distances_has_their_objective(spark, domains):
    frame, how = M.summed(domains, OPTIONS, [1.0, 3.0])
    labels, report = C.clara(frame, how, 2, samples=2, size=500)
    pairs = {(r.i, r.j): r.d for r in M.summed_distances(domains, OPTIONS, [1.0, 3.0]).collect()}
    weight = {r.uid: r.weight for r in D.unique_sequences(frame).collect()}
    ids = sorted(weight)
    d = {(i, j): 0.0 if i == j else pairs[min(i, j), max(i, j)] for i in ids for j in ids}
    best = min(sum(weight[i] * min(d[i, a], d[i, b]) for i in ids) for a, b in itertools.combinations(ids, 2)) / sum(weight.values())
    found = [r.distance for r in report.collect() if r.best]
    assert best - 1e-9 <= found[0] <= 1.1 * best
    assert labels.count() == 37 and {r.cluster for r in labels.collect()} == {1, 2}


def test_representativeness_of_the_best_samples_medoids(spark, domains):
    frame = domains[0]
    how = D.measure(frame, "OM", indel=1.0)
    largest = 14.0
    found, report = C.clara_representativeness(frame, how, 3, largest, samples=2, size=100)
    labels, again = C.clara(frame, how, 3, samples=2, size=100)
    rows: dict = {}
    for r in found.collect():
        rows.setdefault(r.id, {})[r.cluster] = r.representativeness
    assert [tuple(r) for r in report.collect()] == [tuple(r) for r in again.collect()] and len(rows) == 40
    for r in labels.collect():
        own = rows[r.id]
        assert set(own) == {1, 2, 3} and own[r.cluster] == max(own.values()) and all(0 <= x <= 1 for x in own.values())
    mean = np.mean([(1 - max(own.values())) * largest for own in rows.values()])
    assert abs(mean - next(r.distance for r in report.collect() if r.best)) < 1e-9
    with pytest.raises(Exception, match="a distance is above"):
        C.clara_representativeness(frame, how, 3, 0.5, samples=2, size=100)[0].collect()
    with pytest.raises(ValueError):
        C.clara_representativeness(frame, how, 3, 0.0)


def test_arguments_of_summed(domains):
    for bad in ({"options": OPTIONS[:1]}, {"options": OPTIONS, "weights": [1.0, -1.0]}, {"options": OPTIONS, "weights": [0.0, 0.0]}):
        with pytest.raises(ValueError):
            M.summed(domains, **bad)
