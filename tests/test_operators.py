"""Operators on small hand-made tables, and their edge cases."""

import itertools
import math

import numpy as np
import pytest

from trajectra.functions.special import chi_square_tail, gamma_p
from trajectra.operators import clustering as C
from trajectra.operators import distances as D
from trajectra.operators import events as E
from trajectra.operators import hmm as H
from trajectra.operators import indicators as I
from trajectra.operators import sequences as Q
from trajectra.operators import survival as V
from trajectra.operators import transitions as T
from trajectra.operators import uncertainty as U


def frame(spark, sequences, states="abc", **options):
    rows = [(i, p, s) for i, seq in enumerate(sequences) for p, s in enumerate(seq, 1)]
    return Q.build(spark.createDataFrame(rows, "id long, pos int, s string"), "id", "pos", "s", list(states), **options)


def test_missing_values_get_a_state_of_their_own(spark):
    f = Q.with_missing_state(frame(spark, [["a", None, "nan"], ["b", "c", "a"]]))
    assert f.states == ("a", "b", "c", "missing")
    assert {r.id: list(r.seq) for r in f.arrays.collect()} == {0: [1, 4, 4], 1: [2, 3, 1]}


def test_unknown_states_are_errors(spark):
    with pytest.raises(Exception, match="not in the alphabet"):
        frame(spark, [["a", "x"]]).arrays.collect()


def test_validation_counts_repeats(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "a")], "id long, pos int, s string")
    assert Q.validate(Q.build(rows, "id", "pos", "s", ["a", "b"])).first().n_repeated == 1


def test_wide_and_back(spark):
    wide = spark.createDataFrame([(1, "a", "b"), (2, "b", "b")], "id long, t1 string, t2 string")
    f = Q.from_wide(wide, "id", ["t1", "t2"], ["a", "b"])
    assert sorted(map(tuple, Q.to_wide(f, 2).collect())) == [(1, "a", "b"), (2, "b", "b")]


def test_unique_ids_follow_the_order(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "v int")
    assert {r.v: r.id for r in Q.unique_ids(rows, ["v"]).collect()} == {1: 0, 3: 1, 5: 2, 9: 3}


def test_text_forms(spark):
    assert Q.clean_time_names(["id", "wave_12", "2001"]) == ["id", "12", "2001"]
    rows = spark.createDataFrame([("abcd",)], "t string")
    assert Q.fixed_width(rows, "t", 2).first().parts == ["ab", "cd"]
    assert Q.decomposed(spark.createDataFrame([("a-b-*",)], "t string"), "t", "-", "*").first().parts == ["a", "b", None]
    with pytest.raises(Exception, match="multiple"):
        Q.fixed_width(rows, "t", 3).collect()


def test_indicators_of_constant_and_single_sequences(spark):
    rows = {r.id: r for r in I.complexity(frame(spark, [["a"] * 4, ["a", "b", "a", "c"], ["b"]])).collect()}
    assert rows[0].complexity == 0 and rows[2].complexity == 0
    h = -(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25)) / math.log(3)
    assert rows[1].complexity == pytest.approx(math.sqrt(h))


def test_turbulence_counts_subsequences(spark):
    row = I.turbulence(frame(spark, [["a", "b", "a"]])).first()
    assert row.subsequences == 7  # "", a, b, ab, ba, aa, aba


def test_oversized_distances_say_so(spark):
    f = frame(spark, [["a", "b"], ["b", "a"], ["c", "c"]])
    rows = D.unique_sequences(f).selectExpr("uid AS id", "weight")
    with pytest.raises(ValueError, match="clara"):
        C.in_one_group(D.pairwise(f, "HAM"), rows, lambda *_: {}, "id long", most=2)


def test_hamming_needs_equal_lengths(spark):
    with pytest.raises(ValueError, match="equal length"):
        D.pairwise(frame(spark, [["a"], ["a", "b"]]), "HAM")


def test_blocks_cover_all_pairs_once(spark):
    f = frame(spark, [[a, b, c] for a in "abc" for b in "abc" for c in "abc"])
    pairs = D.pairwise(f, "HAM", block=4)
    assert pairs.count() == pairs.select("i", "j").distinct().count() == 27 * 26 // 2
    assert pairs.where("i >= j").count() == 0


def test_expanded_pairs_include_equal_rows(spark):
    f = frame(spark, [["a", "b"], ["a", "b"], ["b", "b"]])
    assert {(r.i, r.j): r.d for r in D.expand(f, D.pairwise(f, "HAM")).collect()} == {(0, 1): 0.0, (0, 2): 1.0, (1, 2): 1.0}


def test_cost_tables_refuse_bad_costs(spark):
    with pytest.raises(ValueError, match="negative"):
        D.measure(frame(spark, [["a"]]), "OM", costs=[[0, -1, 1], [1, 0, 1], [1, 1, 0]])
    assert T.default_indel([1.0, 4.0]) == 2.0


@pytest.mark.parametrize("method", ["single", "complete", "average", "weighted", "ward", "ward_d2", "centroid", "median"])
def test_linkage_finds_clear_clusters(method):
    x = np.array([0.0, 0.1, 0.2, 10, 10.1, 10.2])
    d = np.abs(x[:, None] - x[None])
    assert C.cut(C.linkage_steps(d, np.ones(6), method), 6, 2).tolist() == [1, 1, 1, 2, 2, 2]


def test_divisive_finds_clear_clusters():
    x = np.array([0.0, 0.1, 0.2, 10, 10.1, 10.2])
    d = np.abs(x[:, None] - x[None])
    assert C.cut(C.divisive_steps(d, np.ones(6)), 6, 2).tolist() == [1, 1, 1, 2, 2, 2]


def test_partition_medoids_reach_the_best_pair():
    rng = np.random.default_rng(0)
    x = rng.random((12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    w = rng.random(12) + 0.5
    best = min((float(w @ np.minimum(d[i], d[j])), i, j) for i in range(12) for j in range(i))
    found = C.partition_medoids(d, w, 2)
    assert float(w @ d[:, found].min(axis=1)) <= best[0] * 1.02


def test_events_match_greedily(spark):
    rows = spark.createDataFrame([(1, 0.0, "a"), (1, 1.0, "b"), (1, 5.0, "a"), (1, 9.0, "b"), (2, 0.0, "b")], "id long, ts double, event string")
    counts = {(r.id, r.pattern): r.n for r in E.count_occurrences(rows, [["a", "b"]]).collect()}
    assert counts == {(1, "(a)-(b)"): 2, (2, "(a)-(b)"): 0}
    near = {r.id: r.n for r in E.count_occurrences(rows, [["a", "b"]], E.Constraint(max_gap=2.0)).collect()}
    assert near == {1: 1, 2: 0}


def test_mining_keeps_simultaneous_and_later_apart(spark):
    rows = spark.createDataFrame([(1, 0.0, "a"), (1, 0.0, "b"), (1, 2.0, "a"), (2, 0.0, "a"), (2, 1.0, "b")], "id long, ts double, event string")
    found = {r.pattern: r.support for r in E.frequent_subsequences(rows, 1, 2).collect()}
    assert found == {"(a)": 2, "(b)": 2, "(a,b)": 1, "(a)-(a)": 1, "(b)-(a)": 1, "(a)-(b)": 1}


def test_mining_has_no_longest_pattern(spark):
    rng = np.random.default_rng(7)
    seqs = ["".join(rng.choice(list("abc"), 6)) for _ in range(12)]
    rows = spark.createDataFrame([(i, float(t), e) for i, s in enumerate(seqs) for t, e in enumerate(s)], "id long, ts double, event string")
    within = {None: lambda places: True, 1.0: lambda places: all(b - a <= 1 for a, b in zip(places, places[1:], strict=False))}
    for gap, fits in within.items():
        held: dict = {}
        for i, s in enumerate(seqs):
            for n in range(1, 7):
                for places in itertools.combinations(range(6), n):
                    if fits(places):
                        held.setdefault("-".join(f"({s[p]})" for p in places), set()).add(i)
        want = {p: (p.count("("), len(ids)) for p, ids in held.items() if len(ids) >= 3}
        found = {r.pattern: (r.length, r.support) for r in E.frequent_subsequences(rows, 3, constraint=E.Constraint(max_gap=gap)).collect()}
        assert found == want and (gap or max(n for n, _ in want.values()) > 3)


def test_person_period_refuses_bad_events(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "id long, time int, event int")
    with pytest.raises(Exception, match="event 0 or 1"):
        V.person_period(rows, "id", "time", "event").collect()


def test_expectation_maximization_never_falls(spark):
    f = frame(spark, [list("aabbca"), list("ccabab"), list("bbbaac"), list("acacac")])
    _, history = H.fit([f], 2, rounds=8)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False))


def test_viterbi_equals_brute_force():
    import itertools

    m = H.random_model(2, [3], 5)
    seq = [1, 3, 2, 2]

    def p(path):
        x = m.start[path[0]] * m.emissions[0][path[0], seq[0] - 1]
        for t in range(1, 4):
            x *= m.moves[path[t - 1], path[t]] * m.emissions[0][path[t], seq[t] - 1]
        return x

    best = max(itertools.product(range(2), repeat=4), key=p)
    path, log = H.viterbi(m, [seq])
    assert [x - 1 for x in path] == list(best) and log == pytest.approx(math.log(p(best)))
    assert H.forward_backward(m, [seq])[0] == pytest.approx(math.log(sum(map(p, itertools.product(range(2), repeat=4)))))


def test_replicates_keep_spell_order(spark):
    f = frame(spark, [list("aaabbbccc")])
    rows = U.replicates(f, 20, U.error_distribution(1.0, 3)).collect()
    for r in rows:
        assert len(r.seq) == 9 and [s for i, s in enumerate(r.seq) if i == 0 or r.seq[i - 1] != s] == [1, 2, 3]
    assert any(list(r.seq) != [1, 1, 1, 2, 2, 2, 3, 3, 3] for r in rows)


def test_error_distribution_has_its_mean():
    p = U.error_distribution(1.2, 5)
    assert sum(p) == pytest.approx(1) and sum(k * x for k, x in enumerate(p)) == pytest.approx(1.2)


def test_tails():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert gamma_p(1, 2.0) == pytest.approx(1 - math.exp(-2))


def test_empty_tables(spark):
    f = frame(spark, [])
    assert I.complexity(f).count() == 0
    assert D.pairwise(f, "LCS").count() == 0
    assert T.transition_rates(f).count() == 0
