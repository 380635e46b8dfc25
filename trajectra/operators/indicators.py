"""Indicators of single sequences. All are expressions over the state array: no shuffle after the arrays are built."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.functions import spells as S

from .sequences import SequenceFrame
from .transitions import transition_counts


def base(frame: SequenceFrame) -> DataFrame:
    """(id, seq, weight, length, states, durs, n_spells, visited, counts), from which the indicators are made."""
    seq = F.col("seq")
    found = frame.arrays.select("id", "seq", "weight", F.size(seq).alias("length"), S.distinct_successive(seq).alias("states"), S.durations(seq).alias("durs"), S.state_counts(seq, frame.n_states).alias("counts"))
    return found.withColumns({"n_spells": F.size("states"), "visited": F.size(F.array_distinct("seq"))})


def transitions_share(normalized: bool = True) -> Column:
    """Number of state changes, over the most possible."""
    n = F.greatest(F.col("n_spells") - 1, F.lit(0)).cast("double")
    return F.when(F.col("length") > 1, n / (F.col("length") - 1)).otherwise(0.0) if normalized else n


def entropy(n_states: int, normalized: bool = True) -> Column:
    """Longitudinal entropy of the time spent in the states."""
    h = S.entropy_of(F.col("counts"))
    return h / math.log(n_states) if normalized and n_states > 1 else h


def basic(frame: SequenceFrame) -> DataFrame:
    """(id, length, n_spells, transitions, visited, visited_share, recurrence, mean_duration, sd_duration)."""
    durs = F.col("durs")
    return base(frame).select(
        "id", "length", "n_spells", transitions_share(False).cast("int").alias("transitions"), transitions_share().alias("transitions_share"), "visited",
        (F.col("visited") / frame.n_states).alias("visited_share"), (F.col("n_spells") / F.col("visited")).alias("recurrence"), S.mean(durs).alias("mean_duration"), F.sqrt(S.population_variance(durs)).alias("sd_duration"),
    )


def duration_variance(frame: SequenceFrame, unvisited: bool = False) -> DataFrame:
    """(id, mean_duration, variance, largest): spell durations' variance and its maximum; ``unvisited`` states count as spells of none."""
    d, n, length = F.col("durs"), F.col("n_spells"), F.col("length")
    missing = (F.lit(frame.n_states) - F.col("visited")) if unvisited else F.lit(0)
    m = length / (n + missing)
    squares = F.aggregate(d, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) + missing * m * m
    whole = length / n
    largest = (n - 1) * (1 - whole) * (1 - whole) if not unvisited else ((n - 1) * (1 - m) * (1 - m) + missing * m * m + (length - n + 1 - m) * (length - n + 1 - m)) / (n + missing)
    return base(frame).select("id", m.alias("mean_duration"), (squares / (n + missing)).alias("variance"), largest.alias("largest"))


def state_times(frame: SequenceFrame) -> DataFrame:
    """(id, code, time, share) for every state, zeros included."""
    return base(frame).select("id", "length", F.posexplode("counts").alias("i", "time")).select("id", (F.col("i") + 1).alias("code"), "time", (F.col("time") / F.col("length")).alias("share"))


def complexity(frame: SequenceFrame) -> DataFrame:
    """(id, transitions, visited, entropy, complexity): the geometric mean of normalized transitions and entropy."""
    h = entropy(frame.n_states)
    return base(frame).select("id", transitions_share(False).cast("int").alias("transitions"), "visited", h.alias("entropy"), F.sqrt(transitions_share() * h).alias("complexity"))


def spell_entropy(frame: SequenceFrame, normalized: bool = True) -> DataFrame:
    """(id, entropy_difference): entropy of the spells' shares of time, over ln of the length."""
    h = S.entropy_of(F.col("durs"))
    value = F.when(F.col("length") > 1, h / F.log("length")).otherwise(0.0) if normalized else h
    return base(frame).select("id", value.alias("spell_entropy"))


def turbulence(frame: SequenceFrame, normalized: bool = False, length: int | None = None) -> DataFrame:
    """(id, subsequences, variance, turbulence): log2 of distinct subsequences of the spells' states times a variance ratio.

    Normalized values are scaled by those of a sequence of ``length`` that cycles through the alphabet.
    """
    n = F.col("n_spells")
    whole = F.col("length") / n
    largest = (n - 1) * (1 - whole) * (1 - whole)
    variance = S.population_variance(F.col("durs"))
    phi = S.distinct_subsequences(F.col("states"), frame.n_states)
    value = F.log2(phi * (largest + 1) / (variance + 1))
    if normalized:
        if length is None:
            raise ValueError("normalizing needs the longest length")
        most = _largest_turbulence(frame.n_states, length)
        value = F.when(F.col("length") <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), (value - 1) / (most - 1))) if most > 1 else F.lit(0.0)
    return base(frame).select("id", phi.alias("subsequences"), variance.alias("variance"), value.alias("turbulence"))


def _largest_turbulence(n_states: int, length: int) -> float:
    n, last = 1.0, [0.0] * n_states
    for i in range(length):
        n, last[i % n_states] = 2 * n - last[i % n_states], n
    return math.log2(n)  # spells of one: no variance, and none possible


def volatility(frame: SequenceFrame, weight: float = 0.5, adjust: bool = True) -> DataFrame:
    """(id, volatility): visited share and transitions share, weighted."""
    v = (F.col("visited") - 1) / max(1, frame.n_states - 1) if adjust else F.col("visited") / frame.n_states
    return base(frame).select("id", (weight * v + (1 - weight) * transitions_share()).alias("volatility"))


def _integration(seq: Column, codes: list[int], power: float) -> Column:
    spots = F.sequence(F.lit(1), F.size(seq))
    total = F.aggregate(spots, F.lit(0.0), lambda a, t: a + F.pow(t, F.lit(power)))
    mine = F.aggregate(spots, F.lit(0.0), lambda a, t: a + F.when(F.get(seq, t - 1).isin(codes), F.pow(t, F.lit(power))).otherwise(0.0))
    return mine / total


def integration(frame: SequenceFrame, power: float = 1.0) -> DataFrame:
    """(id, code, integration): for each state, the share of position weights t^power that its positions hold."""
    columns = [_integration(F.col("seq"), [s], power) for s in range(1, frame.n_states + 1)]
    return frame.arrays.select("id", F.posexplode(F.array(*columns)).alias("i", "integration")).select("id", (F.col("i") + 1).alias("code"), "integration")


def positive_negative(frame: SequenceFrame, positive: list[int], negative: list[int], kind: str = "share", power: float = 1.0) -> DataFrame:
    """(id, value): share of positive spells among positive and negative ones, or integration of the positive states."""
    if kind == "share":
        p = F.size(F.filter("states", lambda x: x.isin(positive)))
        n = F.size(F.filter("states", lambda x: x.isin(negative)))
        return base(frame).select("id", (p / F.nullif(p + n, F.lit(0))).alias("value"))
    if kind == "integration":
        return frame.arrays.select("id", _integration(F.col("seq"), positive, power).alias("value"))
    if kind == "volatility":  # changes of sign between spells of either kind, over the most possible
        known = F.filter("states", lambda x: x.isin([*positive, *negative]))
        sides = F.transform(known, lambda x: x.isin(positive).cast("int"))
        moves = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(sides) - 1, F.lit(1))), lambda i: F.get(sides, i) != F.get(sides, i - 1)))
        return base(frame).select("id", (moves / F.nullif(F.col("length") - 1, F.lit(0))).alias("value"))
    raise ValueError("kind is share, integration or volatility")


def precarity_scale(order: list[int], n_states: int, equal: list[list[int]] | None = None) -> list[float]:
    """Per state a number from 0 (first of ``order``) to 1 (last); states of an equal class share their mean, others get the mean."""
    held = {code: i / max(1, len(order) - 1) for i, code in enumerate(order)}
    for group in equal or []:
        known = [held[c] for c in group if c in held]
        for c in group:
            held[c] = sum(known) / len(known)
    rest = sum(held.values()) / len(held)
    return [held.get(c, rest) for c in range(1, n_states + 1)]


def badness(frame: SequenceFrame, scale: list[float], power: float = 1.0) -> DataFrame:
    """(id, badness): the states' precarity weighted by their integration."""
    value = sum((F.lit(scale[s - 1]) * _integration(F.col("seq"), [s], power) for s in range(1, frame.n_states + 1)), F.lit(0.0))
    return frame.arrays.select("id", value.alias("badness"))


DEGRADATION = ("ONE", "RANK", "FREQ", "TRATE", "TRATEDSS")
WEIGHTS = ("ADD", "INV", "LOGINV")


def move_weights(frame: SequenceFrame, scale: list[float], method: str = "RANK", weight: str = "ADD", border: float = 10.0) -> list[list[float]]:
    """What a change of state weighs: one, the states' difference in ``scale``, or by how often it occurs.

    ``FREQ``: its share of all steps; ``TRATE`` its rate from the state, ``TRATEDSS`` that among changes only. Shares x
    become 1 - x (``ADD``), 1 / x (``INV``) or -ln x (``LOGINV``), over the largest, that of a step that never occurs
    included; where a share is near one, all are lowered by a ``border``-th.
    """
    k = frame.n_states
    if method == "ONE":
        return [[float(i != j) for j in range(k)] for i in range(k)]
    if method == "RANK":
        return [[abs(x - y) for y in scale] for x in scale]
    if method not in DEGRADATION or weight not in WEIGHTS or border <= 1:
        raise ValueError(f"method is one of {DEGRADATION}, with + or not, weight one of {WEIGHTS}, border over one")
    counts = [[0.0] * k for _ in range(k)]
    for row in transition_counts(frame).collect():  # the alphabet squared
        if method != "TRATEDSS" or row.s1 != row.s2:
            counts[row.s1 - 1][row.s2 - 1] = row.weight
    whole = sum(map(sum, counts))
    shares = [[0.0 if i == j or not counts[i][j] else counts[i][j] / (whole if method == "FREQ" else sum(counts[i])) for j in range(k)] for i in range(k)]
    if any(x > 1 - 0.1 / border for row in shares for x in row):
        shares = [[x - x / border for x in row] for row in shares]
    tiny = 1e-10
    turn = {"ADD": lambda x: 1 - x, "INV": lambda x: (1 + tiny) / (x + tiny), "LOGINV": lambda x: math.log((1 + tiny) / (x + tiny))}[weight]
    turned = [[turn(x) for x in row] for row in shares]
    most = max(max(map(max, turned)), 0.0) or 1.0
    return [[0.0 if i == j else turned[i][j] / most for j in range(k)] for i in range(k)]


def _degradation(scale: list[float], weights: list[list[float]], penalized: str, spell_integration: bool = False, power: float = 1.0, mean: bool = False) -> Column:
    """Sum over state changes of sign times weight; for the worse in the order of ``scale`` counts plus.

    With ``spell_integration`` the k-th spell counts k^power / (1^power + ... + k^power), else the sum is over that of the
    weights. ``mean`` multiplies by the weights' mean over the spells.
    """
    k = len(scale)
    signs = {"NEG": lambda d: float(d > 0), "POS": lambda d: -float(d < 0), "BOTH": lambda d: float((d > 0) - (d < 0)), "NO": lambda d: 0.0}[penalized]
    table = F.array(*[F.lit(float(weights[i][j])) for i in range(k) for j in range(k)])
    signed = F.array(*[F.lit(float(weights[i][j] * signs(scale[j] - scale[i]))) for i in range(k) for j in range(k)])
    states, n = F.col("states"), F.col("n_spells")
    at = lambda i: (F.get(states, i - 1) - 1) * k + F.get(states, i) - 1
    part = lambda i: F.pow(i + 1, F.lit(power)) / F.aggregate(F.sequence(F.lit(1), i + 1), F.lit(0.0), lambda a, t: a + F.pow(t, F.lit(power))) if spell_integration else F.lit(1.0)
    sums = lambda held: F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, i: a + F.get(held, at(i)) * part(i))
    total, weight = sums(signed), sums(table)
    value = total if spell_integration else total / F.nullif(weight, F.lit(0.0))
    if mean:
        value = value * weight / n
    return F.when(n < 2, 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def degradation(
    frame: SequenceFrame, scale: list[float], method: str = "RANK", penalized: str = "BOTH", weight: str = "ADD", border: float = 10.0, spell_integration: bool = True, power: float = 1.0
) -> DataFrame:
    """(id, degradation): net weight of changes for the worse; a ``+`` after the method multiplies by the mean weight."""
    weights = move_weights(frame, scale, method.removesuffix("+"), weight, border)
    return base(frame).select("id", _degradation(scale, weights, penalized, spell_integration, power, method.endswith("+")).alias("degradation"))


def precarity(frame: SequenceFrame, scale: list[float], otto: float = 0.2, a: float = 1.0, b: float = 1.2, method: str = "TRATEDSS") -> DataFrame:
    """(id, precarity): otto * first state's precarity + (1 - otto) * complexity^a * (1 + degradation)^b."""
    start = F.get(F.array(*[F.lit(x) for x in scale]), F.get("seq", F.lit(0)) - 1)
    ici = F.sqrt(transitions_share() * entropy(frame.n_states))
    correction = _degradation(scale, move_weights(frame, scale, method), "BOTH")
    value = otto * start + (1 - otto) * F.pow(ici, F.lit(a)) * F.pow(1 + correction, F.lit(b))
    return base(frame).select("id", value.alias("precarity"))


def insecurity(frame: SequenceFrame, scale: list[float], power: float = 1.0, bound: bool = False, method: str = "RANK") -> DataFrame:
    """(id, insecurity): first state's precarity times 1 / (1^p + ... + d^p), d its spell's duration, plus complexity and degradation."""
    held = F.array(*[F.lit(x) for x in scale])
    part = 1 / F.aggregate(F.sequence(F.lit(1), F.get("durs", F.lit(0))), F.lit(0.0), lambda a, t: a + F.pow(t, F.lit(power)))
    ici = F.sqrt(transitions_share() * entropy(frame.n_states))
    value = F.get(held, F.get("seq", F.lit(0)) - 1) * part + ici + _degradation(scale, move_weights(frame, scale, method), "BOTH", True, power)
    if bound:
        met = F.transform("states", lambda s: F.get(held, s - 1))
        value = F.least(F.greatest(value, F.array_min(met)), F.array_max(met))
    return base(frame).select("id", value.alias("insecurity"))


def summary(frame: SequenceFrame, what: str = "length") -> DataFrame:
    """(n, mean, median, min, q1, q3, max) of the lengths or transitions."""
    value = F.col("length").cast("double") if what == "length" else transitions_share(False)
    v = base(frame).select(value.alias("v"))
    return v.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.min("v").alias("min"), F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3"), F.max("v").alias("max"))
