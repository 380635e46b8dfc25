"""Costs of states with their moves against loops."""

import itertools

import numpy as np
import pytest

from trajectra.operators import sequences
from trajectra.operators import transition_matching as M


def distance(x, y, sub, dele):
    row = np.concatenate([[0], np.cumsum([dele(t) for t in y])])
    for s in x:
        new = [row[0] + dele(s)]
        for j, t in enumerate(y):
            new.append(min(row[j + 1] + dele(s), new[-1] + dele(t), row[j] + sub(s, t)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("moves", "previous"), itertools.product(M.MOVES, (False, True)))
def test_distances_equal_loops_over_moves(spark, moves, previous):
    rng = np.random.default_rng(5)
    seqs = [[int(s) for s in rng.integers(0, 3, rng.integers(1, 7))] for _ in range(12)]
    seqs = [list(s) for s in dict.fromkeys(map(tuple, seqs))]
    costs, indel, otto = [[0.0, 1.0, 3.0], [1.0, 0.0, 2.0], [3.0, 2.0, 0.0]], [1.0, 1.5, 2.0], 0.3
    data = [(i, p, "abc"[s]) for i, seq in enumerate(seqs) for p, s in enumerate(seq, 1)]
    frame = sequences.build(spark.createDataFrame(data, "id long, pos int, s string"), "id", "pos", "s", "abc")
    count = np.zeros((3, 3))
    for seq in seqs:
        for a, b in itertools.pairwise(seq):
            count[a, b] += 1
    rates = count / np.maximum(1, count.sum(axis=1, keepdims=True))
    move = {"constant": lambda a, b: float(a != b), "rate": lambda a, b: 1 - rates[a, b], "cost": lambda a, b: costs[a][b] / 3}[moves]
    weight = 0.7 * 2 / 3 / (2 if previous else 1)

    def part(t):
        b, s, n = t
        return weight * (move(b, s) + move(s, n)) if previous else weight * (move(s, n) if s != n else 0.0)

    tokens = [[(seq[max(0, i - 1)] if previous else 0, s, seq[min(len(seq) - 1, i + 1)]) for i, s in enumerate(seq)] for seq in seqs]
    sub = lambda x, y: 0.0 if x == y else otto * costs[x[1]][y[1]] / 3 + part(x) + part(y)
    dele = lambda x: otto * indel[x[1]] / 3 + part(x)
    found = {(r.i, r.j): r.d for r in M.transition_matching(frame, moves, previous, otto, costs, indel).collect()}
    assert set(found) == set(itertools.combinations(range(len(seqs)), 2))
    for (i, j), d in found.items():
        assert abs(d - distance(tokens[i], tokens[j], sub, dele)) < 1e-9


def test_arguments(spark):
    frame = sequences.build(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, pos int, s string"), "id", "pos", "s", "ab")
    for bad in ({"moves": "none"}, {"otto": 1.5}, {"costs": [[0.0, 0.0], [0.0, 0.0]]}):
        with pytest.raises(ValueError):
            M.transition_matching(frame, **bad)
    wide = sequences.SequenceFrame(frame.long, tuple(map(str, range(13))), tuple(map(str, range(13))))
    with pytest.raises(ValueError):
        M.transition_matching(wide, previous=True)
