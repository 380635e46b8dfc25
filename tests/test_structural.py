"""Samples of pairs by relation."""

import itertools
from collections import Counter

import pytest

from trajectra.functions.special import chi_square_tail
from trajectra.operators import sequences, structural


def units_of(spark, rows):
    return spark.createDataFrame(rows, "id long, level_1 string, level_2 int")


ROWS = [(i, "abcd"[i % 4] if i % 7 else None, i % 3) for i in range(24)] + [(100, "z", 9)]


def relation(x, y):
    one, two = x[1] == y[1], x[2] == y[2]
    return "same_pair" if one and two else "same_level_1" if one else "same_level_2" if two else "neither"


def all_pairs():
    found: dict = {}
    for x, y in itertools.combinations(ROWS, 2):
        found.setdefault(relation(x, y), set()).add(frozenset((x[0], y[0])))
    return found


def test_counts_and_whole_samples_equal_all_pairs(spark):
    units, expected = units_of(spark, ROWS), all_pairs()
    assert {r.relation: r.n for r in structural.pair_counts(units).collect()} == {k: len(v) for k, v in expected.items()}
    rows = structural.sample_pairs(units, dict.fromkeys(structural.RELATIONS, 10_000)).collect()
    for name in structural.RELATIONS:
        mine = [frozenset((r.i, r.j)) for r in rows if r.relation == name]
        assert len(mine) == len(set(mine)) and set(mine) == expected[name]


@pytest.mark.parametrize("part", [0.25, 2.0])
def test_samples_are_exact_in_number_seeded_and_uniform(spark, monkeypatch, part):
    monkeypatch.setattr(structural, "LARGE_PART", part)  # by numbering all pairs, or by drawing numbers
    units, expected = units_of(spark, ROWS), all_pairs()
    counts: Counter = Counter()
    for seed in range(2):
        rows = structural.sample_pairs(units, {"same_level_1": 9, "neither": 30}, seed).collect()
        assert Counter(r.relation for r in rows) == {"same_level_1": 9, "neither": 30}
        assert all(frozenset((r.i, r.j)) in expected[r.relation] for r in rows)
        counts.update(frozenset((r.i, r.j)) for r in rows if r.relation == "neither")
    again = structural.sample_pairs(units.repartition(5), {"same_level_1": 9, "neither": 30}, 1).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    mean = 60 / len(expected["neither"])
    statistic = sum((counts[p] - mean) ** 2 / mean for p in expected["neither"])
    assert chi_square_tail(statistic, len(expected["neither"]) - 1) > 0.001


def test_distances_of_samples_and_their_contrast(spark):
    units = units_of(spark, ROWS)
    rows = [(i, p, "xyz"[(i * p) % 3] if p != 2 or i % 5 else None) for i, *_ in ROWS for p in (1, 2, 3)]
    frame = sequences.build(spark.createDataFrame(rows, "id long, pos int, s string"), "id", "pos", "s", "xyz")
    at = {(i, p): s for i, p, s in rows}
    found = structural.sampled_by_relation(frame, units, {"same_level_2": 20, "neither": 20}).collect()
    for r in found:
        valid = [p for p in (1, 2, 3) if at[r.i, p] and at[r.j, p]]
        assert abs(r.d - sum(at[r.i, p] != at[r.j, p] for p in valid) / len(valid)) < 1e-12
    table = {r.relation: r for r in structural.contrast(structural.sampled_by_relation(frame, units, {"same_level_2": 20, "neither": 20})).collect()}
    mean = {k: sum(r.d for r in found if r.relation == k) / 20 for k in table}
    assert abs(table["same_level_2"].share - (1 - mean["same_level_2"] / mean["neither"])) < 1e-12 and table["neither"].share == 0


def test_empty_tables_and_arguments(spark):
    units = units_of(spark, ROWS)
    assert structural.sample_pairs(units.where("false"), {"same_level_1": 3, "neither": 3}).count() == 0
    for bad in ({}, {"same_pair": 3}, {"neither": -1}):
        with pytest.raises(ValueError):
            structural.sample_pairs(units, bad)
