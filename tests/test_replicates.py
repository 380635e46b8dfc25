"""Relative timing changes, and distances over the union of replicates."""

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from trajectra.operators import distances as D
from trajectra.operators import sequences
from trajectra.operators import uncertainty as U


@given(st.lists(st.tuples(st.integers(1, 6), st.integers(-8, 8)), min_size=1, max_size=8))
def test_relative_moves_keep_lengths_and_signs(rows):
    durations, shifts = [d for d, _ in rows], [s for _, s in rows][: len(rows) - 1]
    out = U.move_relative(durations, shifts)
    assert sum(out) == sum(durations) and len(out) == len(durations) and min(out) >= 0
    assert U.move_relative(durations, [0] * len(shifts)) == durations


def test_relative_moves_by_hand():
    # Later transitions move along: only the spell before and the last one change.
    assert U.move_relative([3, 2, 4], [1, 0]) == [4, 2, 3]
    assert U.move_relative([3, 2, 4], [-2, 0]) == [1, 2, 6]
    # What a spell lacks is taken from earlier ones, or backwards from the last.
    assert U.move_relative([3, 1, 4], [0, -3]) == [1, 0, 7]
    assert U.move_relative([3, 2, 1], [2, 0]) == [5, 1, 0]
    # What can't be given isn't moved.
    assert U.move_relative([1, 5], [-4]) == [0, 6] and U.move_relative([1, 2], [9]) == [3, 0]


def panel(spark, n=25, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, p, "abc"[int(rng.integers(0, 3))] if p % 3 == 1 else None) for i in range(n) for p in range(1, 13)]
    held, filled = {}, []
    for i, p, s in rows:
        held[i] = s or held[i]
        filled.append((i, p, held[i]))
    return sequences.build(spark.createDataFrame(filled, "id long, pos int, s string"), "id", "pos", "s", "abc")


def test_relative_replicates_keep_the_order_of_spells_and_are_seeded(spark):
    frame = panel(spark)
    errors = U.error_distribution(1.0, 4)
    one = {(r.rep, r.id): list(r.seq) for r in U.relative_replicates(frame, 3, errors, 5).collect()}
    again = {(r.rep, r.id): list(r.seq) for r in U.relative_replicates(sequences.SequenceFrame(frame.long.repartition(7), frame.states, frame.labels), 3, errors, 5).collect()}
    assert one == again and len(one) == 100
    changed = 0
    for (rep, i), seq in one.items():
        source = one[0, i]
        if rep == 0:
            continue
        changed += seq != source
        spells = lambda x: [s for k, s in enumerate(x) if k == 0 or x[k - 1] != s]
        at, own = 0, spells(source)
        for s in spells(seq):  # some may vanish, none is new or out of order
            while own[at] != s:
                at += 1
        assert len(seq) == len(source)
    assert changed > 40


def test_distances_of_replicates_equal_those_of_each(spark):
    frame = panel(spark)
    rows = U.replicates(frame, 3, U.error_distribution(0.8, 3), 2).unionByName(spark.createDataFrame([(3, 500, [1] * 12, 1.0), (3, 501, [1] * 12, 1.0)], "rep int, id long, seq array<int>, weight double"))
    rows = rows.cache()
    for method, options in (("LCS", {}), ("OM", {"costs": "CONSTANT", "indel": 1.0})):
        found = {(r.rep, r.i, r.j): r.d for r in U.replicate_distances(rows, frame, method, **options).collect()}
        total = 0
        for rep in range(4):
            one = U.replicate_frame(rows, rep, frame)
            seqs = {r.id: tuple(r.seq) for r in one.arrays.collect()}
            uid = {tuple(r.seq): r.uid for r in D.unique_sequences(one).collect()}
            pairs = {(r.i, r.j): r.d for r in D.pairwise(one, method, **options).collect()}
            for i in seqs:
                for j in seqs:
                    if i < j:
                        u, v = sorted((uid[seqs[i]], uid[seqs[j]]))
                        assert abs(found[rep, i, j] - (0.0 if u == v else pairs[u, v])) < 1e-9
                        total += 1
        assert len(found) == total
    ham = {(r.i, r.j): r for r in U.distance_spread(rows.where("id < 500")).collect()}
    for r in U.spread_of(U.replicate_distances(rows.where("id < 500"), frame, "HAM")).collect():
        assert all(abs(a - b) < 1e-9 for a, b in zip(tuple(r)[2:], tuple(ham[r.i, r.j])[2:], strict=True))
    near = {(r.rep, r.id, r.ref): r.d for r in U.replicate_reference_distances(rows, frame, [[1] * 12], "LCS").collect()}
    assert near[3, 500, 0] == 0 and len(near) == 4 * 25 + 2
