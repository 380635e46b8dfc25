"""The sequence table: typed categorical sequences with an alphabet.

Two lazily built shapes of the same data: long, one row per (id, pos), for what groups by position
or state; and arrays, one row per id, for what scans within a sequence. States are coded 1..K in
the order of the alphabet. A value that the alphabet doesn't have is missing if it is null or
listed as a missing marker, and then gets the code of the missing state, which is appended to the
alphabet; any other unknown value is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "missing"
MARKERS = ("missing", "nan")


@dataclass(frozen=True)
class SequenceFrame:
    """long: (id, pos, code, weight), unique in (id, pos); states: the alphabet, in code order."""

    long: DataFrame
    states: tuple[str, ...]
    labels: tuple[str, ...]
    missing_code: int | None = None

    @property
    def n_states(self) -> int:
        return len(self.states)

    @cached_property
    def arrays(self) -> DataFrame:
        """(id, seq, weight); a sequence is bounded, so gathering it is."""
        gathered = self.long.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("x"), F.first("weight").alias("weight"))
        return gathered.select("id", F.col("x.code").alias("seq"), "weight")

    @cached_property
    def unique(self) -> DataFrame:
        """(seq, n, weight): distinct sequences with how many rows and how much weight have them."""
        return self.arrays.groupBy("seq").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))

    def state_of(self, code: Column) -> Column:
        """The state's name."""
        return F.get(F.array(*map(F.lit, self.states)), code - 1)


def build(
    rows: DataFrame,
    id: str,
    pos: str,
    state: str,
    states: Sequence[str],
    labels: Sequence[str] | None = None,
    weight: str | None = None,
    missing: Sequence[str] = (),
) -> SequenceFrame:
    """A sequence table from long rows; ``states`` may hold states that don't occur.

    Unknown values raise when the table is read. Null ids, and repeated (id, pos), are for
    :func:`validate` to find.
    """
    states = tuple(map(str, states))
    if len(set(states)) != len(states):
        raise ValueError("states repeat")
    if labels is not None and (len(labels) != len(states) or not all(isinstance(x, str) for x in labels)):
        raise ValueError("labels must be strings, one per state")
    labels = tuple(labels or states)
    markers = {str(m).lower() for m in (*missing, *MARKERS)}
    known = [s for s in states if s.lower() in markers]
    missing_code = states.index(known[0]) + 1 if known else len(states) + 1
    value = F.col(state).cast("string")
    code = F.array_position(F.array(*map(F.lit, states)), value)
    is_missing = value.isNull() | F.lower(value).isin(*sorted(markers))
    coded = F.when(code > 0, code).when(is_missing, F.lit(missing_code)).otherwise(F.raise_error(F.concat(F.lit("state not in the alphabet: "), value)).cast("long"))
    long = rows.select(F.col(id).alias("id"), F.col(pos).cast("int").alias("pos"), coded.cast("int").alias("code"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    return SequenceFrame(long, states, labels, missing_code)


def with_missing_state(frame: SequenceFrame) -> SequenceFrame:
    """The same table with the missing state made part of the alphabet, where it isn't yet."""
    if frame.missing_code is None or frame.missing_code <= frame.n_states:
        return frame
    return SequenceFrame(frame.long, (*frame.states, MISSING), (*frame.labels, "Missing"), frame.missing_code)


def validate(frame: SequenceFrame) -> DataFrame:
    """One row: rows, ids, repeated (id, pos), null ids, shortest and longest sequence."""
    per_id = frame.long.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("n_pos"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("id").alias("n_ids"),
        F.coalesce(F.sum(F.col("n") - F.col("n_pos")), F.lit(0)).alias("n_repeated"),
        F.count_if(F.col("id").isNull()).alias("n_null_ids"),
        F.min("n").alias("shortest"),
        F.max("n").alias("longest"),
    )


def from_wide(rows: DataFrame, id: str, columns: Sequence[str], states: Sequence[str], **options) -> SequenceFrame:
    """A sequence table from one row per id and a column per time point, in the order given."""
    values = F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("at", "state")
    kept = [options["weight"]] if options.get("weight") else []
    long = rows.select(F.col(id).alias("__id"), *kept, values).withColumn("__pos", F.col("at") + 1)
    return build(long, "__id", "__pos", "state", states, **options)


def from_events(rows: DataFrame, id: str, order: Sequence[str], state: str, states: Sequence[str], first: int | None = None, at_least: int | None = None, **options) -> SequenceFrame:
    """A sequence per id of its rows in ``order``; ``first``: so many positions; ``at_least``: ids with fewer are left out."""
    by = Window.partitionBy(id).orderBy(*order)
    placed = rows.withColumn("__pos", F.row_number().over(by))
    if at_least:
        placed = placed.withColumn("__n", F.count("*").over(Window.partitionBy(id))).where(F.col("__n") >= at_least)
    if first:
        placed = placed.where(F.col("__pos") <= first)
    return build(placed, id, "__pos", state, states, **options)


def from_time_grid(rows: DataFrame, id: str, time: str, order: Sequence[str], state: str, states: Sequence[str], grid: Sequence[int], **options) -> SequenceFrame:
    """The last state at each point of a grid, carried forward; before an id's first one it is missing."""
    latest = rows.groupBy(F.col(id).alias("id"), F.col(time).alias("t")).agg(F.max(F.struct(*order, F.col(state).alias("s"))).alias("x")).select("id", "t", F.col("x.s").alias("s"))
    points = latest.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, grid))).alias("t"))
    filled = points.join(latest, ["id", "t"], "left").withColumn("s", F.last("s", ignorenulls=True).over(Window.partitionBy("id").orderBy("t")))
    return with_missing_state(build(filled, "id", "t", "s", states, **options))


def to_wide(frame: SequenceFrame, length: int, prefix: str = "t") -> DataFrame:
    """One row per id and a column per position, with the states' names."""
    named = F.transform("seq", lambda c: frame.state_of(c))
    return frame.arrays.select("id", *[F.get(named, p).alias(f"{prefix}{p + 1}") for p in range(length)])


def uniqueness(frame: SequenceFrame) -> DataFrame:
    """(n, n_unique, rate): distinct sequences over the sum of weights."""
    return frame.unique.agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), (F.count("*") / F.sum("weight")).alias("rate"))


def cross_table(a: SequenceFrame, b: SequenceFrame) -> DataFrame:
    """(state_a, state_b, weight): weighted co-occurrence of two tables by (id, pos); weights are the first's."""
    left = a.long.select("id", "pos", a.state_of(F.col("code")).alias("state_a"), "weight")
    right = b.long.select("id", "pos", b.state_of(F.col("code")).alias("state_b"))
    return left.join(right, ["id", "pos"]).groupBy("state_a", "state_b").agg(F.sum("weight").alias("weight"))


def recode(frame: SequenceFrame, groups: dict[str, Sequence[str]], otherwise: str | None = None) -> SequenceFrame:
    """New states for lists of old ones; others keep their name or become ``otherwise``."""
    to = {old: new for new, olds in groups.items() for old in olds}
    names = [to.get(s, s if otherwise is None else otherwise) for s in frame.states]
    states = tuple(dict.fromkeys(names))
    codes = F.array(*[F.lit(states.index(n) + 1) for n in names])
    long = frame.long.withColumn("code", F.get(codes, F.col("code") - 1))
    return SequenceFrame(long, states, states, None)


def concatenated(frame: SequenceFrame, separator: str = "-") -> DataFrame:
    """(id, text): the states' names joined."""
    return frame.arrays.select("id", F.array_join(F.transform("seq", lambda c: frame.state_of(c)), separator).alias("text"))


def decomposed(rows: DataFrame, text: str, separator: str = "-", miss: str | None = None) -> DataFrame:
    """``rows`` with ``parts``: the text split, with ``miss`` as null."""
    parts = F.split(F.col(text), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")), -1)
    return rows.withColumn("parts", F.transform(parts, lambda x: F.when(x != miss, x)) if miss is not None else parts)


def fixed_width(rows: DataFrame, text: str, width: int) -> DataFrame:
    """``rows`` with ``parts`` of ``width`` characters; a length that isn't a multiple is an error."""
    fits = F.length(text) % width == 0
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{{width}}})"), F.lit(1))
    return rows.withColumn("parts", F.when(fits, parts).otherwise(F.raise_error(F.lit("text isn't a multiple of the width")).cast("array<string>")))


def shifted(frame: SequenceFrame, k: int) -> DataFrame:
    """(id, seq): the first k states moved to the end, nulls before them."""
    seq = F.col("seq")
    return frame.arrays.select("id", F.concat(F.array_repeat(F.lit(None).cast("int"), F.size(seq) - k), F.slice(seq, 1, k)).alias("seq"))


def numeric_codes(frame: SequenceFrame) -> DataFrame:
    """(id, codes): 0-based codes, null for the missing state."""
    missing = frame.missing_code or -1
    return frame.arrays.select("id", F.transform("seq", lambda c: F.when(c != missing, c - 1)).alias("codes"))


def occurrences(frame: SequenceFrame, of: SequenceFrame) -> DataFrame:
    """(id, found_in): ids of ``of`` whose sequence equals that of each id of ``frame``."""
    return frame.arrays.select("id", "seq").join(of.arrays.select(F.col("id").alias("found_in"), "seq"), "seq").select("id", "found_in")


def missing_summary(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing, share) for each column."""
    names = list(columns or rows.columns)
    counts = rows.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(names)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("n_missing")) for i, c in enumerate(names)])).alias("x")
    return counts.select("__n", pairs).select("x.column", "x.n_missing", (F.col("x.n_missing") / F.nullif(F.col("__n"), F.lit(0))).alias("share"))


def long_to_wide(rows: DataFrame, id: str, time: str, values: Sequence[str], times: Sequence) -> DataFrame:
    """One row per id; a column per value and time point, named value_time."""
    return rows.groupBy(id).agg(*[F.first(F.when(F.col(time) == t, F.col(v)), ignorenulls=True).alias(f"{v}_{t}") for v in values for t in times])


def wide_to_long(rows: DataFrame, id: str, columns: Sequence[str], time: str = "time", value: str = "state") -> DataFrame:
    """One row per id and column."""
    return rows.unpivot([id], list(columns), time, value)


def unique_ids(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """``rows`` with 0..n-1 in ``order``, as a column before the others.

    Ranges are sorted and counted, so that the numbers are those of a global sort without one task
    holding all rows.
    """
    import uuid

    part = f"__part_{uuid.uuid4().hex[:8]}"
    ranged = rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    local = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    sizes = ranged.groupBy(part).agg(F.count("*").alias("__n"))  # a row per range
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy(part)) - F.col("__n")).select(part, "__before")
    return local.join(F.broadcast(before), part).select((F.col("__rank") + F.col("__before") - 1).alias(name), *[F.col(f"`{c}`") for c in rows.columns])


def clean_time_names(names: Sequence[str]) -> list[str]:
    """Column names with letters become their last number; others stay."""
    import re

    out = []
    for name in names:
        numbers = re.findall(r"\d+", name)
        out.append(numbers[-1] if numbers and re.search("[A-Za-z]", name) else name)
    return out


def describe(frame: SequenceFrame) -> DataFrame:
    """One row: sequences, distinct ones, states, positions, shortest and longest length, and positions that are missing."""
    per = frame.arrays.agg(F.count("*").alias("n"), F.countDistinct("seq").alias("n_unique"), F.min(F.size("seq")).alias("shortest"), F.max(F.size("seq")).alias("longest"))
    places = frame.long.agg(F.count("*").alias("n_positions"), F.count_if(F.col("code") == (frame.missing_code or 0)).alias("n_missing"))
    return per.join(F.broadcast(places), how="cross").select("n", "n_unique", F.lit(frame.n_states).alias("n_states"), "n_positions", "shortest", "longest", "n_missing")


def cut_prefixes(frame: SequenceFrame, least: int) -> DataFrame:
    """(id, seq): each sequence up to its first code under ``least``."""
    low = F.array_position(F.transform("seq", lambda c: c < least), True)
    return frame.arrays.select("id", F.when(low > 0, F.slice("seq", 1, F.greatest(low - 1, F.lit(0)).cast("int"))).otherwise(F.col("seq")).alias("seq"))


def _two(frame: SequenceFrame, pairs: DataFrame) -> DataFrame:
    a, b = frame.arrays.select(F.col("id").alias("i"), F.col("seq").alias("x")), frame.arrays.select(F.col("id").alias("j"), F.col("seq").alias("y"))
    return pairs.select("i", "j").join(a, "i").join(b, "j").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "x", "y")


def common_lengths(frame: SequenceFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, prefix, subsequence): lengths of the longest common prefix and subsequence of the rows of given pairs (i, j)."""

    def run(batches):
        for batch in batches:
            prefix, common = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                prefix.append(next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y))))
                row = [0] * (len(y) + 1)
                for a in x:
                    last, corner = row, 0
                    row = [0]
                    for n, b in enumerate(y, 1):
                        row.append(corner + 1 if a == b else max(last[n], row[-1]))
                        corner = last[n]
                common.append(row[-1])
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(prefix, pa.int32()), pa.array(common, pa.int32())], names=["i", "j", "prefix", "subsequence"])

    return _two(frame, pairs).mapInArrow(run, "i long, j long, prefix int, subsequence int")


def alignments(frame: SequenceFrame, pairs: DataFrame, costs: list[list[float]], indel: float) -> DataFrame:
    """(i, j, step, operation, a, b, cost): a cheapest alignment of the rows of given pairs, step by step.

    Of equal ways back, matching or substituting comes before deleting, and that before inserting.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "x", "y")), strict=True):
                table = [[n * indel for n in range(len(y) + 1)]]
                for a in x:
                    row = [table[-1][0] + indel]
                    for n, b in enumerate(y, 1):
                        row.append(min(table[-1][n - 1] + costs[a - 1][b - 1], table[-1][n] + indel, row[-1] + indel))
                    table.append(row)
                m, n, steps = len(x), len(y), []
                while m or n:
                    here = table[m][n]
                    if m and n and abs(table[m - 1][n - 1] + costs[x[m - 1] - 1][y[n - 1] - 1] - here) < 1e-9:
                        steps.append(("match" if x[m - 1] == y[n - 1] else "substitute", x[m - 1], y[n - 1], costs[x[m - 1] - 1][y[n - 1] - 1]))
                        m, n = m - 1, n - 1
                    elif m and abs(table[m - 1][n] + indel - here) < 1e-9:
                        steps.append(("delete", x[m - 1], None, indel))
                        m -= 1
                    else:
                        steps.append(("insert", None, y[n - 1], indel))
                        n -= 1
                out += [(i, j, k, *s) for k, s in enumerate(reversed(steps), 1)]
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["i", "j", "step", "operation", "a", "b", "cost"])

    return _two(frame, pairs).mapInArrow(run, "i long, j long, step int, operation string, a int, b int, cost double")


def spells_between_gaps(frame: SequenceFrame) -> DataFrame:
    """(id, spell, code, begin, dur): runs of one state, where a missing position ends a run and is in none."""
    by = Window.partitionBy("id").orderBy("pos")
    known = frame.long.where(F.col("code") != (frame.missing_code or 0))
    new = F.lag("code").over(by).isNull() | (F.lag("code").over(by) != F.col("code")) | (F.lag("pos").over(by) != F.col("pos") - 1)
    marked = known.withColumn("spell", F.sum(new.cast("int")).over(by).cast("int"))
    return marked.groupBy("id", "spell").agg(F.first("code").alias("code"), F.min("pos").alias("begin"), F.count("*").cast("int").alias("dur"))
