"""Occurrences of patterns with steps of several events, counted in one pass over each id's events.

A pattern is a list of steps, each a list of events that must happen at one time; steps follow at
later times. Events are dealt by id and sorted by descending time, and a task reads them as a
stream. For every pattern an automaton keeps, for each number of steps matched from the end, the
open matches by time with the earliest end that they reach, of which only those are kept that a
later one doesn't beat. So each event costs a constant time per step, an id of any length needs no
more memory than its open matches within ``max_gap``, and every embedding counts: a first fit that
leads nowhere doesn't hide another.

Counts of a pattern in an id:

* ``starts``: times at which an occurrence begins;
* ``minimal``: windows from a start to an end that hold an occurrence, and no smaller window does;
* ``disjoint``: occurrences that don't overlap in time, as many as there can be;
* ``windows``: of all windows [g, g + width], g a multiple of ``step``, those that hold an occurrence.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import Constraint, parse_pattern

Pattern = Sequence[Sequence[str]]


class Automaton:
    """One pattern against an id's times, latest first."""

    def __init__(self, steps: list[frozenset], limit: Constraint) -> None:
        self.steps, self.limit = steps[::-1], limit
        self.reset()

    def reset(self) -> None:
        self.open: list[deque] = [deque() for _ in self.steps]

    def meet(self, t: float, found: set) -> float | None:
        """The earliest end of an occurrence that begins at ``t``, where ``found`` happens; shorter matches that begin here stay open."""
        first, last = None, len(self.steps) - 1
        for k in range(last, -1, -1):  # the longest first, so that no match takes two steps at one time
            end = self._end(k, t) if self.steps[k] <= found else None
            if end is None:
                continue
            if k < last:
                self._push(k, t, end)
            elif (self.limit.age_min is None or t >= self.limit.age_min) and (self.limit.age_max is None or t <= self.limit.age_max):
                first = end
        return first

    def _end(self, k: int, t: float) -> float | None:
        """The earliest end of the last ``k + 1`` steps, the first of them at ``t``."""
        if k == 0:
            return t if self.limit.age_max_end is None or t <= self.limit.age_max_end else None
        held = self.open[k - 1]
        while held and self.limit.max_gap is not None and held[0][0] - t > self.limit.max_gap:
            held.popleft()
        return held[0][1] if held and (self.limit.window is None or held[0][1] - t <= self.limit.window) else None

    def _push(self, k: int, t: float, end: float) -> None:
        held = self.open[k]
        while held and held[-1][1] >= end:
            held.pop()
        held.append((t, end))


def _text(pattern: Pattern) -> str:
    return "-".join("(" + ",".join(step) + ")" for step in pattern)


def _checked(patterns: Sequence[Pattern | str]) -> list[tuple[str, list[frozenset]]]:
    split = [parse_pattern(p) if isinstance(p, str) else p for p in patterns]
    if any(not p or not all(p) for p in split):
        raise ValueError("a pattern has a step, and each step an event")
    return [(_text(p), [frozenset(step) for step in p]) for p in split]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, time, events at that time), as they come: by id, latest first."""
    last, found = None, set()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("id", "ts", "event")), strict=True):
            if last is not None and row[:2] != last:
                yield *last, found
                found = set()
            last = row[:2]
            found.add(row[2])
    if last is not None:
        yield *last, found


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("ts").cast("double").alias("ts"), "event").repartition("id").sortWithinPartitions("id", F.desc("ts"))


def occurrence_windows(rows: DataFrame, patterns: Sequence[Pattern | str], constraint: Constraint = Constraint()) -> DataFrame:
    """(id, pattern, start, end, minimal): each time at which a pattern begins, with the earliest end, and whether no smaller window has one.

    ``rows``: (id, ts, event), as of ``events``.
    """
    wanted = _checked(patterns)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, pattern string, start double, end double, minimal boolean"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [(text, Automaton(steps, constraint)) for text, steps in wanted]
        least = [math.inf] * len(machines)
        out: list[tuple] = []
        kind, last = None, object()
        for id_, t, found in _moments(_typed(batches, kinds := [])):
            kind = kinds[0]
            if id_ != last:
                last, least = id_, [math.inf] * len(machines)
                for _, m in machines:
                    m.reset()
            for i, (text, m) in enumerate(machines):
                end = m.meet(t, found)
                if end is not None:
                    out.append((id_, text, t, end, end < least[i]))
                    least[i] = min(least[i], end)
            if len(out) > 10_000:
                yield _rows(out, kind, [pa.string(), pa.float64(), pa.float64(), pa.bool_()], ["id", "pattern", "start", "end", "minimal"])
                out = []
        if out:
            yield _rows(out, kind, [pa.string(), pa.float64(), pa.float64(), pa.bool_()], ["id", "pattern", "start", "end", "minimal"])

    return _ordered(rows).mapInArrow(scan, schema)


def _typed(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds.append(batch.schema.field("id").type) if not kinds else None
        yield batch


def _rows(rows: list[tuple], kind: pa.DataType, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [kind, *types], strict=True)], names=names)


class Counts:
    """The four counts of a pattern in an id, from its starts and earliest ends, latest first."""

    def __init__(self) -> None:
        self.starts = self.minimal = self.disjoint = self.windows = 0
        self.least = self.free = self.counted = math.inf

    def add(self, start: float, end: float, width: float, step: float) -> None:
        self.starts += 1
        if end < self.free:
            self.disjoint, self.free = self.disjoint + 1, start
        if end < self.least:
            self.minimal, self.least = self.minimal + 1, end
            first, last = math.ceil((end - width) / step), min(math.floor(start / step), self.counted - 1)
            self.windows += max(0, last - first + 1)
            self.counted = min(self.counted, first)


def count_windows(rows: DataFrame, patterns: Sequence[Pattern | str], width: float, step: float = 1.0, constraint: Constraint = Constraint()) -> DataFrame:
    """(id, pattern, starts, minimal, disjoint, windows) for each id with events and each pattern.

    ``width`` and ``step`` (above 0) are those of ``windows``; ``constraint`` limits all occurrences.
    """
    if step <= 0 or width < 0:
        raise ValueError("step is above 0 and width not below")
    wanted = _checked(patterns)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, pattern string, starts long, minimal long, disjoint long, windows long"
    types, names = [pa.string(), *[pa.int64()] * 4], ["id", "pattern", "starts", "minimal", "disjoint", "windows"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [Automaton(steps, constraint) for _, steps in wanted]
        counts = [Counts() for _ in wanted]
        out: list[tuple] = []
        kinds: list = []
        some, last = False, None
        for id_, t, found in _moments(_typed(batches, kinds)):
            if some and id_ != last:
                out += [(last, text, c.starts, c.minimal, c.disjoint, c.windows) for (text, _), c in zip(wanted, counts, strict=True)]
                counts = [Counts() for _ in wanted]
                for m in machines:
                    m.reset()
                if len(out) > 10_000:
                    yield _rows(out, kinds[0], types, names)
                    out = []
            some, last = True, id_
            for m, c in zip(machines, counts, strict=True):
                end = m.meet(t, found)
                if end is not None:
                    c.add(t, end, width, step)
        if some:
            out += [(last, text, c.starts, c.minimal, c.disjoint, c.windows) for (text, _), c in zip(wanted, counts, strict=True)]
        if out:
            yield _rows(out, kinds[0], types, names)

    return _ordered(rows).mapInArrow(scan, schema)
