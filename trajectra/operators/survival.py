"""Event history: person-period data, sequence histories, moving windows for multistate models, spell survival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajectra.functions import spells as S

from .sequences import SequenceFrame


def person_period(rows: DataFrame, id: str, time: str, event: str) -> DataFrame:
    """A row per id and period 1..time; the event stands in the last one. Times under 1 and other events than 0 and 1 are errors."""
    good = (F.col(time) >= 1) & F.col(event).isin(0, 1)
    checked = F.when(good, F.col(time)).otherwise(F.raise_error(F.lit("time must be 1 or more, event 0 or 1")).cast("int")).cast("int")
    others = [c for c in rows.columns if c not in (id, time, event)]
    periods = rows.select(id, *others, checked.alias("__t"), F.col(event).cast("int").alias("__e")).withColumn("period", F.explode(F.sequence(F.lit(1), F.col("__t"))))
    return periods.select(id, *others, "period", F.when(F.col("period") == F.col("__t"), F.col("__e")).otherwise(0).alias("event"))


def sequence_history(persons: DataFrame, frame: SequenceFrame, id: str, time: str, event: str, include_present: bool = False, align_end: bool = False) -> DataFrame:
    """Person-period rows with ``past``: the states up to the period, null-padded at the end, or at the start with ``align_end``."""
    periods = person_period(persons, id, time, event).withColumnRenamed(id, "id")
    known = F.least(F.col("period") if include_present else F.col("period") - 1, F.size("seq"))
    past = F.slice("seq", F.lit(1), known)
    pad = F.array_repeat(F.lit(None).cast("int"), F.size("seq") - known)
    joined = periods.join(frame.arrays.select("id", "seq"), "id")
    return joined.select(*periods.columns, (F.concat(pad, past) if align_end else F.concat(past, pad)).alias("past"))


def moving_windows(frame: SequenceFrame, length: int, void: list[int] | None = None) -> DataFrame:
    """(id, time, states, begin, spell_time, transition, last_observed): windows of ``length`` states from each position.

    ``begin`` is where the window's first spell began, ``spell_time`` how long it has lasted, and
    ``transition`` says that the state changes right after the first. Windows with void states are left out.
    """
    rows = frame.arrays.where(F.size("seq") > length - 1).select("id", "seq", S.changes(F.col("seq")).alias("begins"), F.explode(F.sequence(F.lit(1), F.size("seq") - length + 1)).alias("time"))
    states = F.slice("seq", F.col("time"), F.lit(length))
    begin = F.array_max(F.filter("begins", lambda b: b <= F.col("time")))
    out = rows.select(
        "id", "time", states.alias("states"), begin.alias("begin"), (F.col("time") - begin + 1).alias("spell_time"),
        (F.get("seq", F.col("time") - 1) != F.get("seq", F.col("time"))).alias("transition"), (F.col("time") + length - 1 == F.size("seq")).alias("last_observed"),
    )
    return out.where(~F.exists("states", lambda s: s.isin(void))) if void else out


def after_leaving(windows: DataFrame, spell: int) -> DataFrame:
    """The windows that begin with the last position of a spell in ``spell``."""
    return windows.where((F.get("states", F.lit(0)) == spell) & F.col("transition"))


def typed_history(windows: DataFrame, spell: int, types: DataFrame) -> DataFrame:
    """Rows at risk in ``spell`` with a column per type of what follows: 1 where the spell is left for it.

    ``types``: (id, time, type) for the rows of :func:`after_leaving`.
    """
    at_risk = windows.where(F.get("states", F.lit(0)) == spell)
    names = sorted(r[0] for r in types.select("type").distinct().collect())  # a typology is small
    joined = at_risk.join(types, ["id", "time"], "left")
    return joined.select("id", "time", "begin", "spell_time", "last_observed", *[F.when(F.col("transition") & (F.col("type") == n), 1).otherwise(0).alias(f"type_{n}") for n in names])


def spell_survival(frame: SequenceFrame, by_state: bool = True, group: DataFrame | None = None) -> DataFrame:
    """(stratum, time, at_risk, events, survival, se): weighted Kaplan-Meier curves of spell durations.

    A spell that reaches the sequence's end is censored. Durations are reduced per stratum before the
    running products, which are sums of logarithms; a curve at zero stays there.
    """
    spells = frame.arrays.select("id", "weight", F.size("seq").alias("n"), F.explode(S.spells(F.col("seq"))).alias("x"))
    ended = (F.col("x.begin") + F.col("x.dur") - 1 < F.col("n")).cast("double")
    rows = spells.select("id", "weight", F.col("x.state").alias("state"), F.col("x.dur").alias("time"), ended.alias("event"))
    stratum = F.col("state").cast("string") if by_state else F.lit("all")
    if group is not None:
        rows, stratum = rows.join(group, "id"), F.col("group").cast("string")
    counts = rows.groupBy(stratum.alias("stratum"), "time").agg(F.sum("weight").alias("left_"), F.sum(F.col("weight") * F.col("event")).alias("events"))
    forward = Window.partitionBy("stratum").orderBy("time")
    at_risk = F.sum("left_").over(forward.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    risks = counts.withColumn("at_risk", at_risk)
    all_gone = F.col("events") >= F.col("at_risk") - 1e-12
    step = F.when(all_gone, 0.0).otherwise(F.log(1 - F.col("events") / F.col("at_risk")))
    green = F.when(all_gone, 0.0).otherwise(F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events"))))
    gone = F.max(all_gone.cast("int")).over(forward)
    survival = F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(step).over(forward)))
    out = risks.select("stratum", "time", "at_risk", "events", survival.alias("survival"), F.sum(green).over(forward).alias("g"))
    return out.select("stratum", "time", "at_risk", "events", "survival", (F.col("survival") * F.sqrt("g")).alias("se"))
