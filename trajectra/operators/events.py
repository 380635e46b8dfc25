"""Event sequences: time-stamped events per id, frequent subsequences, counts, and comparison of groups.

A pattern is a list of steps, each a list of events that happen together: [["A", "B"], ["C"]] is A
and B at one time, then C later, written (A,B)-(C). Mining grows patterns one event at a time from
the places where they end: a row per pattern, id and end, joined to the id's later (or
simultaneous) events and reduced before it is counted, so it is a sequence of joins on id and no
task holds more than some ids' events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.functions.special import chi_square_tail

from .sequences import SequenceFrame
from .tables import not_sent_whole, stored


#: Frequent patterns that are sent to all tasks at most.
MOST_SENT = 100_000


@dataclass(frozen=True)
class Constraint:
    """Limits of an occurrence; None is none. ``age_max`` holds for its first event, ``age_max_end`` for its last."""

    max_gap: float | None = None
    window: float | None = None
    age_min: float | None = None
    age_max: float | None = None
    age_max_end: float | None = None


def events(rows: DataFrame, id: str, ts: str, event: str) -> DataFrame:
    """(id, ts, event): distinct events; nulls are errors when read."""
    null = F.col(id).isNull() | F.col(ts).isNull() | F.col(event).isNull()
    checked = F.when(null, F.raise_error(F.lit("id, time and event may not be null")).cast("double")).otherwise(F.col(ts).cast("double"))
    return rows.select(F.col(id).alias("id"), checked.alias("ts"), F.col(event).cast("string").alias("event")).distinct()


def dictionary(rows: DataFrame) -> DataFrame:
    """(event, code): the events in order, from 1."""
    return rows.select("event").distinct().withColumn("code", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("event")))  # a row per event


def from_states(frame: SequenceFrame, kind: str = "transition") -> DataFrame:
    """(id, ts, event): what happens in state sequences; the first state at 0, others at their position less 1.

    ``transition``: "A>B"; ``state``: "B"; ``period``: "endA,beginB".
    """
    name = frame.state_of(F.col("code"))
    rows = frame.long.select("id", "pos", name.alias("s")).withColumn("last", F.lag("s").over(Window.partitionBy("id").orderBy("pos")))
    moved = rows.where(F.col("last").isNull() | (F.col("last") != F.col("s")))
    first = F.col("last").isNull()
    later = {"transition": F.concat_ws(">", "last", "s"), "state": F.col("s"), "period": F.concat(F.lit("end"), F.col("last"), F.lit(",begin"), F.col("s"))}
    if kind not in later:
        raise ValueError("kind is transition, state or period")
    begin = F.concat(F.lit("begin"), F.col("s")) if kind == "period" else F.col("s")
    return moved.select("id", (F.col("pos") - 1).cast("double").alias("ts"), F.when(first, begin).otherwise(later[kind]).alias("event"))


def pattern_text(pattern: Column) -> Column:
    """(A,B)-(C) of an array of arrays."""
    return F.array_join(F.transform(pattern, lambda step: F.concat(F.lit("("), F.array_join(step, ","), F.lit(")"))), "-")


def parse_pattern(text: str) -> list[list[str]]:
    return [step.strip("()").split(",") for step in text.split(")-(")]


def frequent_subsequences(rows: DataFrame, min_support: float, longest: int | None = None, weights: DataFrame | None = None, constraint: Constraint = Constraint()) -> DataFrame:
    """(pattern, length, support, share): patterns whose ids weigh ``min_support`` or more, of up to ``longest`` events; None is no limit.

    Patterns grow until none of a length is frequent; each round is a stored table, so that plans don't grow.
    ``rows``: (id, ts, event); ``weights``: (id, weight), else 1 each.
    """
    rows = stored(rows)
    people = rows.select("id").distinct()
    people = stored(people.join(weights, "id") if weights is not None else people.withColumn("weight", F.lit(1.0)))
    total = people.agg(F.sum("weight").alias("total"))
    start = rows.select("id", "ts", "event")
    if constraint.age_min is not None:
        start = start.where(F.col("ts") >= constraint.age_min)
    if constraint.age_max is not None:
        start = start.where(F.col("ts") <= constraint.age_max)
    ends = start.select(F.array(F.array("event")).alias("pattern"), "id", F.col("ts").alias("first"), F.col("ts").alias("last"))
    ends, found = _keep_frequent(stored(ends), people, min_support, constraint)
    out = found.withColumn("length", F.lit(1))
    length = 1
    later = not_sent_whole(rows.select("id", F.col("ts").alias("t"), F.col("event").alias("e")))
    while (longest is None or length < longest) and found.count():
        length += 1
        joined = ends.join(later, "id").where(F.col("t") >= F.col("last"))
        tail = F.element_at("pattern", -1)
        together = (F.col("t") == F.col("last")) & (F.col("e") > F.element_at(tail, -1))
        after = F.col("t") > F.col("last")
        if constraint.max_gap is not None:
            after = after & (F.col("t") - F.col("last") <= constraint.max_gap)
        if constraint.window is not None:
            after = after & (F.col("t") - F.col("first") <= constraint.window)
        head = F.slice("pattern", F.lit(1), F.size("pattern") - 1)
        grown = F.when(after, F.concat("pattern", F.array(F.array("e")))).otherwise(F.concat(head, F.array(F.concat(tail, F.array("e")))))
        # Of equal ends the latest start is enough: it allows the most.
        ends = joined.where(after | together).select(grown.alias("pattern"), "id", "first", F.col("t").alias("last")).groupBy("pattern", "id", "last").agg(F.max("first").alias("first")).select("pattern", "id", "first", "last")
        ends, found = _keep_frequent(stored(ends), people, min_support, constraint)
        out = out.unionByName(found.withColumn("length", F.lit(length)))
    return out.join(F.broadcast(total), how="cross").select(pattern_text(F.col("pattern")).alias("pattern"), "length", "support", (F.col("support") / F.col("total")).alias("share"))


def _keep_frequent(ends: DataFrame, people: DataFrame, least: float, constraint: Constraint) -> tuple[DataFrame, DataFrame]:
    done = ends if constraint.age_max_end is None else ends.where(F.col("last") <= constraint.age_max_end)
    support = not_sent_whole(done.select("pattern", "id").distinct()).join(people, "id").groupBy("pattern").agg(F.sum("weight").alias("support")).where(F.col("support") >= least)
    support = stored(support)  # a row per pattern
    kept = support.select("pattern")
    kept = F.broadcast(kept) if support.count() <= MOST_SENT else kept
    return not_sent_whole(ends.join(kept, "pattern", "left_semi")), support


def arrays(rows: DataFrame) -> DataFrame:
    """(id, x): each id's events as an ordered array of (ts, event)."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "event"))).alias("x"))


def _completes(pattern: list[str], c: Constraint) -> str:
    """SQL: whether the events from place i on hold the pattern, each step the first that fits."""
    steps = ", ".join("'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in pattern)
    fits = "e.event = array({0})[a.k]".format(steps)
    if c.max_gap is not None:
        fits += f" AND e.ts - a.last <= {c.max_gap}D"
    if c.window is not None:
        fits += f" AND e.ts - a.first <= {c.window}D"
    n = len(pattern)
    final = "a.k = " + str(n) + (f" AND a.last <= {c.age_max_end}D" if c.age_max_end is not None else "")
    begin = f"x[i].event = array({steps})[0]"
    if c.age_min is not None:
        begin += f" AND x[i].ts >= {c.age_min}D"
    if c.age_max is not None:
        begin += f" AND x[i].ts <= {c.age_max}D"
    return f"""({begin} AND aggregate(slice(x, i + 2, size(x)), named_struct('k', 1, 'first', x[i].ts, 'last', x[i].ts),
        (a, e) -> IF(a.k < {n} AND CASE WHEN a.k < {n} THEN {fits} ELSE false END, named_struct('k', a.k + 1, 'first', a.first, 'last', e.ts), a), a -> {final}))"""


def count_occurrences(rows: DataFrame, patterns: Sequence[Sequence[str]], constraint: Constraint = Constraint(), presence: bool = False) -> DataFrame:
    """(id, pattern, n): at how many events an occurrence of the pattern begins, or whether any does; steps of one event each."""
    held = arrays(rows)
    columns = []
    if not patterns:
        return held.where("false").select("id", F.lit("").alias("pattern"), F.lit(0).alias("n"))
    for p in patterns:
        places = f"filter(sequence(0, size(x) - 1), i -> {_completes(list(p), constraint)})"
        n = F.expr(f"size({places})")
        columns.append(F.struct(F.lit("(" + ")-(".join(p) + ")").alias("pattern"), (F.least(n, F.lit(1)) if presence else n).alias("n")))
    return held.select("id", F.explode(F.array(*columns)).alias("c")).select("id", "c.pattern", "c.n")


def presence(rows: DataFrame, patterns: Sequence[Sequence[str]]) -> DataFrame:
    """(id, pattern, n): whether an id has each pattern, as ``count_occurrences`` with ``presence`` and no limits, for any number of patterns.

    Patterns of like beginnings are walked together, each step to the first event that fits, and a walk ends where an id has none.
    """
    tree: dict = {}
    for at, pattern in enumerate(patterns):
        node, own = tree, []
        for event in pattern:
            node, own = node.setdefault(event, ({}, []))
        own.append(at)
    names = pa.array(["(" + ")-(".join(p) + ")" for p in patterns], pa.string())

    def walk(events: list[str]) -> np.ndarray:
        has = np.zeros(len(patterns), np.int32)
        open_ = [(tree, 0)]
        while open_:
            node, start = open_.pop()
            for event, (below, own) in node.items():
                try:
                    at = events.index(event, start)
                except ValueError:
                    continue
                has[own] = 1
                if below:
                    open_.append((below, at + 1))
        return has

    def find(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                has = [walk(x) for x in part.column("x").to_pylist()]
                n = part.num_rows
                ids = part.column("id").take(pa.array(np.repeat(np.arange(n), len(patterns))))
                yield pa.RecordBatch.from_arrays([ids, names.take(pa.array(np.tile(np.arange(len(patterns)), n))), pa.array(np.concatenate(has))], names=["id", "pattern", "n"])

    held = arrays(rows).select("id", F.col("x.event").alias("x"))
    return held.mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, pattern string, n int")


def contains(rows: DataFrame, pattern: Sequence[str], constraint: Constraint = Constraint()) -> DataFrame:
    """(id, contained)."""
    return count_occurrences(rows, [pattern], constraint, presence=True).select("id", (F.col("n") > 0).alias("contained"))


def compare_groups(counts: DataFrame, groups: DataFrame, adjust: bool = True) -> DataFrame:
    """(pattern, statistic, p_value): chi-square of presence by group, ``groups`` as (id, group); Yates-corrected for two groups.

    With ``adjust``, p is 1 - (1 - p)^m for m patterns. A pattern that all or none have gets 0 and 1.
    """
    table = counts.select("id", "pattern", (F.col("n") > 0).cast("double").alias("has")).join(groups, "id").groupBy("pattern", "group").agg(F.sum("has").alias("yes"), F.count("*").cast("double").alias("n"))
    totals = table.groupBy("pattern").agg(F.sum("yes").alias("all_yes"), F.sum("n").alias("all_n"), F.count("*").alias("k"))
    joined = table.join(totals, "pattern")
    e_yes, e_no = F.col("all_yes") * F.col("n") / F.col("all_n"), (F.col("all_n") - F.col("all_yes")) * F.col("n") / F.col("all_n")
    gap = F.abs(F.col("yes") - e_yes)
    fair = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    part = F.when((e_yes > 0) & (e_no > 0), fair * fair / e_yes + fair * fair / e_no).otherwise(0.0)
    stats = joined.groupBy("pattern").agg(F.sum(part).alias("statistic"), (F.first("k") - 1).cast("int").alias("degrees"))
    m = counts.select("pattern").distinct().count() if adjust else 1

    def tails(batches):
        for batch in batches:
            p = [1.0 if s <= 0 or d < 1 else chi_square_tail(s, d) for s, d in zip(batch.column("statistic").to_pylist(), batch.column("degrees").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pattern"), batch.column("statistic"), pa.array([1 - (1 - x) ** m for x in p], pa.float64())], names=["pattern", "statistic", "p_value"])

    return stats.mapInArrow(tails, "pattern string, statistic double, p_value double")


def event_transitions(rows: DataFrame, normalized: bool = True) -> DataFrame:
    """(e1, e2, n[, rate]): adjacent events of each id, in order of time and name."""
    by = Window.partitionBy("id").orderBy("ts", "event")
    moved = rows.withColumn("e2", F.lead("event").over(by)).where("e2 IS NOT NULL")
    counts = moved.groupBy(F.col("event").alias("e1"), "e2").agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("e1"))) if normalized else counts


def situation_rates(frame: SequenceFrame, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """(pos1, s1, pos2, s2, rate, discounted): of those in s1 at pos1, the share in s2 at a later pos2, and that over a * lag + b."""
    x = frame.long.select("id", F.col("pos").alias("pos1"), F.col("code").alias("s1"), "weight")
    y = frame.long.select("id", F.col("pos").alias("pos2"), F.col("code").alias("s2"))
    both = x.join(y, "id").where("pos2 > pos1").groupBy("pos1", "s1", "pos2", "s2").agg(F.sum("weight").alias("w"))
    size = frame.long.groupBy(F.col("pos").alias("pos1"), F.col("code").alias("s1")).agg(F.sum("weight").alias("n"))
    rate = F.col("w") / F.col("n")
    return both.join(size, ["pos1", "s1"]).select("pos1", "s1", "pos2", "s2", rate.alias("rate"), (rate / (a * (F.col("pos2") - F.col("pos1")) + b)).alias("discounted"))


def situation_distances(frame: SequenceFrame, pos: int, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """(s1, s2, d): distance of the discounted futures of two states at a position, each situation weighted by one over its share."""
    rates = situation_rates(frame, a, b).where(F.col("pos1") == pos).select("s1", "pos2", "s2", "discounted")
    share = frame.long.groupBy("pos", "code").agg(F.sum("weight").alias("w")).withColumn("f", F.col("w") / F.sum("w").over(Window.partitionBy("pos"))).select(F.col("pos").alias("pos2"), F.col("code").alias("t"), "f")
    states = rates.select("s1").distinct()
    grid = states.join(share.where(F.col("pos2") > pos), how="cross")  # states times situations
    full = grid.join(rates.select("s1", "pos2", F.col("s2").alias("t"), "discounted"), ["s1", "pos2", "t"], "left").withColumn("v", F.coalesce("discounted", F.lit(0.0)))
    p, q = full.select(F.col("s1").alias("u"), "pos2", "t", "f", F.col("v").alias("x")), full.select(F.col("s1").alias("w"), "pos2", "t", F.col("v").alias("y"))
    return p.join(q, ["pos2", "t"]).where("u < w").groupBy(F.col("u").alias("s1"), F.col("w").alias("s2")).agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")) / F.col("f"))).alias("d"))
