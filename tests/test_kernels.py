"""The block kernels against plain definitions, pair by pair."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trajectra.functions import kernels as K

K_STATES = 3
SEQS = st.lists(st.lists(st.integers(1, K_STATES), max_size=6), min_size=1, max_size=4)
COSTS = [[0.0, 1.2, 2.0], [1.2, 0.0, 0.7], [2.0, 0.7, 0.0]]


def edit(x, y, sub, dele, ins):
    d = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            options = [d[i - 1][j] + dele(i - 1, j)] if i else []
            options += [d[i][j - 1] + ins(i, j - 1)] if j else []
            options += [d[i - 1][j - 1] + sub(i - 1, j - 1)] if i and j else []
            d[i][j] = min(options) if options else 0.0
    return d[-1][-1]


def check(raw, xs, ys, one):
    for a, x in enumerate(xs):
        for b, y in enumerate(ys):
            assert raw[a, b] == pytest.approx(one(x, y), abs=1e-9), (x, y)


@settings(max_examples=60, deadline=None)
@given(SEQS, SEQS)
def test_optimal_matching(xs, ys):
    sm, indel = K.padded_costs(COSTS), np.array([0, 1.0, 0.8, 1.5])
    raw = K.optimal_matching(K.Block.of(xs), K.Block.of(ys), sm, indel)[0]
    check(raw, xs, ys, lambda x, y: edit(x, y, lambda i, j: sm[x[i], y[j]], lambda i, j: indel[x[i]], lambda i, j: indel[y[j]]))


@settings(max_examples=60, deadline=None)
@given(SEQS, SEQS)
def test_longest_common_subsequence(xs, ys):
    def lcs(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        return len(x) + len(y) - 2 * t[-1][-1]

    check(K.longest_common_subsequence(K.Block.of(xs), K.Block.of(ys))[0], xs, ys, lcs)


@settings(max_examples=60, deadline=None)
@given(SEQS, SEQS)
def test_spell_matching(xs, ys):
    sm, indel, w = K.padded_costs(COSTS), np.array([0, 1.0, 1.0, 1.0]), 0.5

    def block(seqs):
        both = [K.spells_of(s) for s in seqs]
        return K.Block.of([s for s, _ in both], [d for _, d in both])

    def one(x, y):
        (sx, dx), (sy, dy) = K.spells_of(x), K.spells_of(y)

        def sub(i, j):
            return w * abs(dx[i] - dy[j]) if sx[i] == sy[j] else sm[sx[i], sy[j]] + w * (dx[i] + dy[j] - 2)

        return edit(sx, sy, sub, lambda i, j: 1 + w * (dx[i] - 1), lambda i, j: 1 + w * (dy[j] - 1))

    check(K.spell_matching(block(xs), block(ys), sm, indel, w)[0], xs, ys, one)


@settings(max_examples=60, deadline=None)
@given(SEQS, SEQS)
def test_time_warp(xs, ys):
    sm, nu, h, indel = K.padded_costs(COSTS), 0.3, 0.2, 2.5

    def one(x, y):
        d = [[i * indel if j == 0 else j * indel if i == 0 else math.inf for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                a, b, pa, pb = x[i - 1], y[j - 1], x[i - 2] if i > 1 else 0, y[j - 2] if j > 1 else 0
                sub = d[i - 1][j - 1] + (0 if (a, pa) == (b, pb) else sm[a, b] + sm[pa, pb]) + 2 * nu * abs(i - j)
                if (i == 1) != (j == 1):
                    sub = math.inf
                d[i][j] = min(sub, d[i][j - 1] + sm[b, pb] + nu + h if j > 1 else math.inf, d[i - 1][j] + sm[a, pa] + nu + h if i > 1 else math.inf)
        return d[-1][-1]

    check(K.time_warp(K.Block.of(xs), K.Block.of(ys), sm, nu, h, indel)[0], xs, ys, one)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), max_size=4), min_size=1, max_size=3))
def test_matching_subsequences(xs):
    def count(x, y):
        n = 0
        for k in range(1, min(len(x), len(y)) + 1):
            for a in itertools.combinations(range(len(x)), k):
                for b in itertools.combinations(range(len(y)), k):
                    n += [x[i] for i in a] == [y[j] for j in b]
        return n

    raw = K.subsequence_distance(K.Block.of(xs), K.Block.of(xs))[0]
    check(raw, xs, xs, lambda x, y: math.sqrt(max(0, count(x, x) + count(y, y) - 2 * count(x, y))))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), min_size=1, max_size=6), min_size=1, max_size=3))
def test_matching_spell_times(xs):
    both = [K.spells_of(s) for s in xs]
    block = K.Block.of([s for s, _ in both], [d for _, d in both])

    def value(x, y, kind):
        (sx, dx), (sy, dy) = x, y
        total = 0
        for k in range(1, min(len(sx), len(sy)) + 1):
            for a in itertools.combinations(range(len(sx)), k):
                for b in itertools.combinations(range(len(sy)), k):
                    if [sx[i] for i in a] == [sy[j] for j in b]:
                        total += sum(dx[i] for i in a) * sum(dy[j] for j in b) if kind == "product" else sum(min(dx[i], dy[j]) for i, j in zip(a, b, strict=True))
        return total

    for kind in ("product", "shared"):
        found = K.subsequence_attributes(block, block, None, None, kind)
        for i, j in itertools.product(range(len(xs)), repeat=2):
            assert found[i, j] == pytest.approx(value(both[i], both[j], kind))


@pytest.mark.parametrize("norm", ["none", "maxlength", "gmean", "maxdist", "YujianBo"])
def test_normalizations_of_equal_and_empty_sequences(norm):
    block = K.Block.of([[1, 2], [], [1, 2], [3]])
    d = K.normalized(K.longest_common_subsequence(block, block), norm)
    assert d[0, 2] == pytest.approx(0) and d[1, 1] == pytest.approx(0) and np.isfinite(d).all()
    assert d[0, 3] > 0


@settings(max_examples=80, deadline=None)
@given(SEQS, SEQS)
def test_localized(xs, ys):
    """The two items met are carried from cell to cell, also from the end of a row to the next."""
    sm, e, g = K.padded_costs(COSTS), 0.1, 0.8
    top = sm.max()

    def one(x, y):
        cost = lambda s, met: e * top + g * (sm[met[0], s] + sm[met[1], s]) / 2
        if not x or not y:
            return max(len(x), len(y)) * (e + g) * top
        above = [0.0, *itertools.accumulate(cost(s, (x[0], x[0])) for s in y)]
        met = (y[0], y[0])
        for i, s in enumerate(x):
            row = [cost(s, met) if i == 0 else sum(cost(t, (y[-1], y[-1])) for t in x[: i + 1])]
            for j, t in enumerate(y):
                row.append(min(above[j + 1] + cost(s, met), row[j] + cost(t, (x[max(i - 1, 0)], s)), above[j] + sm[s, t]))
                met = (t, y[min(j + 1, len(y) - 1)])
            above = row
        return above[-1]

    check(K.localized(K.Block.of(xs), K.Block.of(ys), sm, e, g)[0], xs, ys, one)


def test_common_subsequences_of_several_words():
    rng = np.random.default_rng(1)
    xs, ys = ([rng.integers(1, 6, n).tolist() for n in rng.integers(0, 150, 30)] for _ in range(2))
    x, y = K.Block.of(xs), K.Block.of(ys)
    slow = K.optimal_matching(x, y, K.padded_costs((2.0 * (1 - np.eye(5))).tolist()), np.r_[0.0, np.ones(5)])[0]
    assert (K.longest_common_subsequence(x, y)[0] == slow).all()


def test_tiles_in_order_of_length_give_the_same_distances():
    from trajectra.operators.distances import Measure

    rng = np.random.default_rng(2)
    xs, ys = ([rng.integers(1, 4, n).tolist() for n in rng.integers(0, 30, 250)] for _ in range(2))
    sm, indel = K.padded_costs(COSTS), np.r_[0.0, np.ones(3)]
    how = Measure(lambda a, b: K.optimal_matching(a, b, sm, indel), "none")
    x, y = how.block(xs), how.block(ys)
    assert (how.distances(x, y) == K.optimal_matching(x, y, sm, indel)[0]).all()


def test_gains_that_fit_a_byte_are_summed_in_bytes(monkeypatch):
    kinds, plain = [], K._scaled
    monkeypatch.setattr(K, "_scaled", lambda values, kind, scale: kinds.append(kind) or plain(values, kind, scale))
    costs, indels = K.padded_costs((2.0 * (1 - np.eye(3))).tolist()), np.array([0, 0.5, 0.75, 1.0])
    rng = np.random.default_rng(1)
    for longest, kind in ((20, np.uint8), (63, np.uint8), (64, np.int16), (90, np.int16)):
        x = [rng.integers(1, 4, rng.integers(1, longest)).tolist() for _ in range(5)] + [[3] * longest]
        raw = K.optimal_matching(K.Block.of(x), K.Block.of(x), costs, indels)[0]
        assert kinds.pop() is kind
        check(raw[:, -1:], x, x[-1:], lambda p, q: edit(p, q, lambda i, j: costs[p[i], q[j]], lambda i, j: indels[p[i]], lambda i, j: indels[q[j]]))
    # The limit is that of the best matches: 127 of 2 are 254 and just fit.
    for longest, kind in ((127, np.uint8), (128, np.int16)):
        x = K.Block.of([[1] * longest, [1] * 3])
        assert K.optimal_matching(x, x, K.padded_costs([[0.0, 3.0], [3.0, 0.0]]), np.array([0, 1.0, 0.5]))[0].tolist() == [[0.0, longest - 3.0], [longest - 3.0, 0.0]]
        assert kinds.pop() is kind
