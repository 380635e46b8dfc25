"""Expressions over a state array: spells, durations, lengths and counts of subsequences.

They stay in the JVM and look at one row at a time. States are positive integer codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def changes(seq: Column) -> Column:
    """1-based positions at which a spell begins."""
    return F.filter(F.sequence(F.lit(1), F.size(seq)), lambda p: (p == 1) | (F.get(seq, p - 1) != F.get(seq, p - 2)))


def distinct_successive(seq: Column) -> Column:
    """The states of the spells."""
    return F.when(F.size(seq) == 0, seq).otherwise(F.transform(changes(seq), lambda p: F.get(seq, p - 1)))


def durations(seq: Column) -> Column:
    """The lengths of the spells."""
    starts = changes(seq)
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(seq) + 1))
    return F.when(F.size(seq) == 0, F.array().cast("array<int>")).otherwise(F.zip_with(ends, starts, lambda e, s: e - s))


def spells(seq: Column) -> Column:
    """array<struct<state,begin,dur>> in order."""
    return F.zip_with(F.zip_with(distinct_successive(seq), changes(seq), lambda s, b: F.struct(s.alias("state"), b.alias("begin"))), durations(seq), lambda x, d: F.struct(x["state"].alias("state"), x["begin"].alias("begin"), d.alias("dur")))


def state_counts(seq: Column, n_states: int) -> Column:
    """How often each code 1..n occurs."""
    return F.array(*[F.size(F.filter(seq, _is(s))) for s in range(1, n_states + 1)])


def _is(state: int):
    return lambda x: x == state


def entropy_of(counts: Column) -> Column:
    """Natural-log Shannon entropy of an array of counts; zero counts add nothing."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.when(x > 0, -(x / total) * F.log(x / total)).otherwise(0.0))


def distinct_subsequences(seq: Column, n_states: int) -> Column:
    """The number of distinct subsequences, the empty one included, as a double.

    N_i = 2 N_{i-1} - N before the state's last occurrence; the accumulator keeps that number per state.
    """
    zero = F.struct(F.lit(1.0).alias("n"), F.array_repeat(F.lit(0.0), n_states).alias("last"))

    def step(a: Column, x: Column) -> Column:
        grown = 2 * a["n"] - F.get(a["last"], x - 1)
        return F.struct(grown.alias("n"), F.transform(a["last"], lambda v, i: F.when(i == x - 1, a["n"]).otherwise(v)).alias("last"))

    return F.aggregate(seq, zero, step, lambda a: a["n"])


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def population_variance(values: Column) -> Column:
    """Mean of squares about the mean."""
    m = mean(values)
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values)
