"""Counts of occurrences by windows against all embeddings."""

import itertools
import math
import random

import pytest

from trajectra.operators import event_counts as C
from trajectra.operators.events import Constraint

PATTERNS = [[["a"]], [["a"], ["b"]], [["a", "b"], ["a"]], [["a"], ["a"], ["b"]], [["b"], ["a", "c"], ["b"]]]


def embeddings(times: dict, pattern, c: Constraint):
    """All (start, end) of occurrences; times: time to events."""
    for places in itertools.combinations(sorted(times), len(pattern)):
        gaps = [b - a for a, b in itertools.pairwise(places)]
        if not all(set(s) <= times[t] for s, t in zip(pattern, places, strict=True)):
            continue
        if c.max_gap is not None and any(g > c.max_gap for g in gaps) or c.window is not None and places[-1] - places[0] > c.window:
            continue
        if c.age_min is not None and places[0] < c.age_min or c.age_max is not None and places[0] > c.age_max or c.age_max_end is not None and places[-1] > c.age_max_end:
            continue
        yield places[0], places[-1]


def expected(times, pattern, c, width, step):
    found = set(embeddings(times, pattern, c))
    earliest = {s: min(e for x, e in found if x == s) for s, _ in found}
    minimal = {(s, e) for s, e in found if not any((x, y) != (s, e) and x >= s and y <= e for x, y in found)}
    best = 0
    free = math.inf
    for s, e in sorted(found, reverse=True, key=lambda w: (w[0], -w[1])):
        if e < free:
            best, free = best + 1, s
    grid = [g * step for g in range(-40, 80)]
    windows = sum(any(g <= s and e <= g + width for s, e in found) for g in grid)
    return len(earliest), len(minimal), best, windows, earliest, minimal


@pytest.mark.parametrize("limit", [Constraint(), Constraint(max_gap=2), Constraint(window=4), Constraint(max_gap=3, window=5, age_min=1, age_max=9, age_max_end=12)])
def test_counts_equal_all_embeddings(spark, limit):
    rng = random.Random(4)
    rows = sorted({(i, float(rng.randrange(14)), rng.choice("abc")) for i in range(25) for _ in range(rng.randrange(1, 18))})
    df = spark.createDataFrame(rows, "id long, ts double, event string")
    counts = {(r.id, r.pattern): (r.starts, r.minimal, r.disjoint, r.windows) for r in C.count_windows(df, PATTERNS, 4.0, 1.5, limit).collect()}
    windows: dict = {}
    for r in C.occurrence_windows(df, PATTERNS, limit).collect():
        windows.setdefault((r.id, r.pattern), []).append((r.start, r.end, r.minimal))
    ids = {r[0] for r in rows}
    assert len(counts) == len(ids) * len(PATTERNS)
    for i in ids:
        times: dict = {}
        for j, t, e in rows:
            if j == i:
                times.setdefault(t, set()).add(e)
        for pattern in PATTERNS:
            text = C._text(pattern)
            *four, earliest, minimal = expected(times, pattern, limit, 4.0, 1.5)
            assert counts[i, text] == tuple(four), (i, text)
            held = windows.get((i, text), [])
            assert {(s, e) for s, e, _ in held} == set(earliest.items()) and {(s, e) for s, e, m in held if m} == minimal


def test_texts_of_patterns_empty_tables_and_errors(spark):
    df = spark.createDataFrame([("x", 1.0, "a"), ("x", 2.0, "b"), (None, 1.0, "a")], "id string, ts double, event string")
    rows = sorted(map(tuple, C.count_windows(df, ["(a)-(b)"], 1.0).collect()), key=str)
    assert rows == [("x", "(a)-(b)", 1, 1, 1, 1), (None, "(a)-(b)", 0, 0, 0, 0)]
    assert C.count_windows(df.where("false"), ["(a)"], 1.0).count() == 0 and C.occurrence_windows(df.where("false"), ["(a)"]).count() == 0
    for bad in ([[]], [[[]]]):
        with pytest.raises(ValueError):
            C.count_windows(df, bad, 1.0)
    with pytest.raises(ValueError):
        C.count_windows(df, ["(a)"], 1.0, 0.0)
