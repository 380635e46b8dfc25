"""Queries on single sequences, cross-sections and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import cross_section as X
from trajectra.operators import indicators as I
from trajectra.operators import sequences as Q
from trajectra.operators import transitions as T
from trajectra.sources import fixtures as fx

from .rounding import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SCALE = [0.25, 1.0, 0.0, 0.5, 0.75]  # of the events' states, from purchase to error


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


EV, SP = fx.SQL["ev_all"], fx.SPELLS_SQL
#: CTE "one": id, length, n_spells, visited, mean and variance of durations; "ent": entropy of time per state.
ONE = f"""WITH {EV}, {SP},
 ln AS (SELECT id, count(*) AS length, count(DISTINCT s) AS visited FROM p GROUP BY id),
 spn AS (SELECT id, count(*) AS n_spells, avg(d) AS md, var_pop(d) AS vd, arg_min(s, k) AS s1, arg_min(d, k) AS d1 FROM sp GROUP BY id),
 one AS (SELECT * FROM ln JOIN spn USING (id)),
 st AS (SELECT id, s, count(*) AS n FROM p GROUP BY id, s),
 ent AS (SELECT id, -sum(n / length * ln(n / length)) AS h FROM st JOIN ln USING (id) GROUP BY id),
 mv AS (SELECT id, k, s AS a, lead(s) OVER (PARTITION BY id ORDER BY k) AS b FROM sp),
 sc(s, v) AS (VALUES (1, 0.25), (2, 1.0), (3, 0.0), (4, 0.5), (5, 0.75)),
 deg AS (SELECT id, avg(sign(y.v - x.v)) AS g FROM mv JOIN sc x ON a = x.s JOIN sc y ON b = y.s GROUP BY id),
 tot AS (SELECT id, sum(pos) AS w FROM p GROUP BY id)
"""
CI = "sqrt((n_spells - 1) / (length - 1) * h / ln(5))"


@query("seq_complexity", ONE + f"SELECT id, CAST(n_spells - 1 AS INT) AS transitions, CAST(visited AS INT) AS visited, round(h / ln(5), 6) AS entropy, round({CI}, 6) AS complexity FROM one JOIN ent USING (id)")
def _(spark, d):
    return I.complexity(fx.ev_all(spark, d))


@query("seq_basic", ONE + "SELECT id, CAST(length AS INT) AS length, CAST(n_spells AS INT) AS n_spells, CAST(n_spells - 1 AS INT) AS transitions, round((n_spells - 1) / (length - 1), 6) AS transitions_share, CAST(visited AS INT) AS visited, round(visited / 5, 6) AS visited_share, round(n_spells / visited, 6) AS recurrence, round(md, 6) AS mean_duration, round(sqrt(vd), 6) AS sd_duration FROM one")
def _(spark, d):
    return I.basic(fx.ev_all(spark, d))


@query("seq_duration_variance", ONE + "SELECT id, round(md, 6) AS mean_duration, round(vd, 6) AS variance, round((n_spells - 1) * (1 - length / n_spells) ** 2, 6) AS largest FROM one")
def _(spark, d):
    return I.duration_variance(fx.ev_all(spark, d))


@query("seq_state_times", f"WITH {EV}, ids AS (SELECT DISTINCT id FROM p), g AS (SELECT id, CAST(c AS INT) AS code FROM ids, (SELECT unnest(range(1, 6)) AS c)) SELECT id, code, CAST(count(s) AS INT) AS time, round(count(s) / any_value(ln.n), 6) AS share FROM g LEFT JOIN p USING (id) JOIN (SELECT id, count(*) AS n FROM p GROUP BY id) ln USING (id) WHERE s = code OR s IS NULL GROUP BY id, code UNION ALL SELECT id, code, 0, 0.0 FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = g.id AND p.s = g.code)")
def _(spark, d):
    return I.state_times(fx.ev_all(spark, d))


@query("seq_spell_entropy", ONE + "SELECT id, round(-sum(d / length * ln(d / length)) / ln(any_value(length)), 6) AS spell_entropy FROM sp JOIN ln USING (id) GROUP BY id")
def _(spark, d):
    return I.spell_entropy(fx.ev_all(spark, d))


@query("seq_turbulence", ONE + """, r AS (WITH RECURSIVE t AS (
   SELECT id, CAST(0 AS BIGINT) AS k, 1.0::DOUBLE AS n, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS last FROM one
   UNION ALL SELECT t.id, t.k + 1, 2 * n - last[sp.s], list_transform(last, lambda v, i: CASE WHEN i = sp.s THEN n ELSE v END) FROM t JOIN sp ON sp.id = t.id AND sp.k = t.k + 1)
   SELECT id, arg_max(n, k) AS phi FROM t GROUP BY id)
 SELECT id, phi AS subsequences, round(vd, 6) AS variance, round(log2(phi * ((n_spells - 1) * (1 - length / n_spells) ** 2 + 1) / (vd + 1)), 6) AS turbulence FROM one JOIN r USING (id)""")
def _(spark, d):
    return I.turbulence(fx.ev_all(spark, d))


@query("seq_volatility", ONE + "SELECT id, round(0.5 * (visited - 1) / 4 + 0.5 * (n_spells - 1) / (length - 1), 6) AS volatility FROM one")
def _(spark, d):
    return I.volatility(fx.ev_all(spark, d))


@query("seq_integration", ONE + ", g AS (SELECT id, w, CAST(c AS INT) AS code FROM tot, (SELECT unnest(range(1, 6)) AS c)), m AS (SELECT id, s, sum(pos) AS x FROM p GROUP BY id, s) SELECT g.id, code, round(coalesce(x, 0) / w, 6) AS integration FROM g LEFT JOIN m ON m.id = g.id AND m.s = g.code")
def _(spark, d):
    return I.integration(fx.ev_all(spark, d))


@query("seq_positive_share", ONE + "SELECT id, round(count(*) FILTER (s IN (3, 4)) / nullif(count(*) FILTER (s IN (3, 4, 2)), 0), 6) AS value FROM sp GROUP BY id")
def _(spark, d):
    return I.positive_negative(fx.ev_all(spark, d), [3, 4], [2])


@query("seq_positive_integration", ONE + "SELECT id, round(coalesce(sum(pos) FILTER (s IN (3, 4)), 0) / sum(pos), 6) AS value FROM p GROUP BY id")
def _(spark, d):
    return I.positive_negative(fx.ev_all(spark, d), [3, 4], [2], "integration")


@query("seq_badness", ONE + "SELECT id, round(sum(v * pos / w), 6) AS badness FROM p JOIN sc USING (s) JOIN tot USING (id) GROUP BY id")
def _(spark, d):
    return I.badness(fx.ev_all(spark, d), SCALE)


def _degradation_sql(method: str, weight: str, integrated: bool, mean: bool) -> str:
    """CTEs up to "dg" (id, g): the degradation index in both directions."""
    share = {"FREQ": "sum(n) OVER ()", "TRATE": "sum(n) OVER (PARTITION BY a)", "TRATEDSS": "sum(n) FILTER (a <> b) OVER (PARTITION BY a)"}.get(method, "1")
    turned = {"ADD": "1 - x", "INV": "(1 + 1e-10) / (x + 1e-10)", "LOGINV": "ln((1 + 1e-10) / (x + 1e-10))"}[weight]
    by_count = f"w AS (SELECT a, b, CASE WHEN a = b THEN 0 ELSE y / max(y) OVER () END AS w FROM (SELECT a, b, {turned} AS y FROM (SELECT a, b, CASE WHEN max(x) OVER () > 0.99 THEN x - x / 10 ELSE x END AS x FROM sh)))"
    rank = "abs(x.v - y.v)" if method == "RANK" else "1.0"
    weights = by_count if method in ("FREQ", "TRATE", "TRATEDSS") else f"w AS (SELECT x.s AS a, y.s AS b, {rank} AS w FROM sc x, sc y)"
    part = "2.0 / k" if integrated else "1.0"  # of the k-th spell: k / (1 + ... + k), k counted from the spell moved to
    value = "total" if integrated else "total / nullif(weight, 0)"
    return f""", cn AS (SELECT s AS a, nx AS b, count(*) AS n FROM (SELECT s, lead(s) OVER (PARTITION BY id ORDER BY pos) AS nx FROM p) WHERE nx IS NOT NULL GROUP BY ALL),
 ab AS (SELECT x.s AS a, y.s AS b FROM sc x, sc y), ca AS (SELECT ab.a, ab.b, coalesce(n, 0) AS n FROM ab LEFT JOIN cn ON cn.a = ab.a AND cn.b = ab.b),
 sh AS (SELECT a, b, CASE WHEN a = b THEN 0 ELSE n / {share} END AS x FROM ca), {weights},
 st2 AS (SELECT id, w * {part} AS w, w * sign(y.v - x.v) * {part} AS g FROM (SELECT id, a, b, k + 2 AS k FROM mv WHERE b IS NOT NULL) m JOIN w USING (a, b) JOIN sc x ON a = x.s JOIN sc y ON b = y.s),
 dg AS (SELECT one.id, coalesce({value}, 0){" * weight / n_spells" if mean else ""} AS g FROM one LEFT JOIN (SELECT id, sum(g) AS total, sum(w) AS weight FROM st2 GROUP BY id) USING (id))"""


for _method, _weight, _integrated in (("ONE", "ADD", False), ("RANK", "ADD", True), ("RANK+", "ADD", False), ("FREQ", "ADD", False), ("FREQ", "INV", True), ("TRATE", "ADD", True), ("TRATE", "LOGINV", False), ("TRATEDSS", "ADD", False), ("TRATEDSS+", "LOGINV", True)):
    _name = "seq_degradation" + ("" if _method == "ONE" else "_" + _method.lower().replace("+", "_mean") + ("" if _weight == "ADD" else "_" + _weight.lower()))

    @query(_name, ONE + _degradation_sql(_method.removesuffix("+"), _weight, _integrated, _method.endswith("+")) + " SELECT id, round(coalesce(g, 0), 6) AS degradation FROM dg")
    def _(spark, d, method=_method, weight=_weight, integrated=_integrated):
        return I.degradation(fx.ev_all(spark, d), SCALE, method, weight=weight, spell_integration=integrated)


@query("seq_positive_volatility", ONE + ", kn AS (SELECT id, s IN (3, 4) AS good, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM sp WHERE s IN (3, 4, 2)), fl AS (SELECT id, count(*) AS n FROM (SELECT id, good, lag(good) OVER (PARTITION BY id ORDER BY i) AS last FROM kn) WHERE last <> good GROUP BY id) SELECT id, round(coalesce(n, 0) / (length - 1), 6) AS value FROM one LEFT JOIN fl USING (id)")
def _(spark, d):
    return I.positive_negative(fx.ev_all(spark, d), [3, 4], [2], "volatility")


@query("seq_precarity", ONE + _degradation_sql("TRATEDSS", "ADD", False, False) + f" SELECT id, round(0.2 * v + 0.8 * {CI} * (1 + g) ** 1.2, 6) AS precarity FROM one JOIN ent USING (id) JOIN dg USING (id) JOIN sc ON sc.s = s1")
def _(spark, d):
    return I.precarity(fx.ev_all(spark, d), SCALE)


@query("seq_insecurity", ONE + _degradation_sql("RANK", "ADD", True, False) + f" SELECT id, round(v * 2 / (d1 * (d1 + 1)) + {CI} + g, 6) AS insecurity FROM one JOIN ent USING (id) JOIN dg USING (id) JOIN sc ON sc.s = s1")
def _(spark, d):
    return I.insecurity(fx.ev_all(spark, d), SCALE)


@query("seq_length_summary", f"WITH {fx.SQL['ord_seq']}, l AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM p GROUP BY id) SELECT count(*) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, max(v) AS max FROM l")
def _(spark, d):
    return I.summary(fx.ord_seq(spark, d))


@query("seq_spells", f"WITH {fx.SQL['ord_seq']}, {SP} SELECT id, CAST(k AS INT) AS spell, CAST(s AS INT) AS state, CAST(b AS INT) AS begin, CAST(d AS INT) AS dur FROM sp")
def _(spark, d):
    from trajectra.functions import spells as S

    return fx.ord_seq(spark, d).arrays.select("id", F.posexplode(S.spells(F.col("seq"))).alias("i", "x")).select("id", (F.col("i") + 1).alias("spell"), "x.state", "x.begin", "x.dur")


DIST = f"WITH {EV}, g AS (SELECT CAST(pos AS INT) AS pos, CAST(c AS INT) AS code FROM (SELECT DISTINCT pos FROM p), (SELECT unnest(range(1, 6)) AS c)), n AS (SELECT pos, s AS code, count(*) AS w FROM p GROUP BY ALL), dist AS (SELECT g.pos, g.code, CAST(coalesce(w, 0) AS DOUBLE) AS weight, coalesce(w, 0) / sum(coalesce(w, 0)) OVER (PARTITION BY g.pos) AS share FROM g LEFT JOIN n USING (pos, code))"


@query("xs_state_distribution", DIST + " SELECT pos, code, weight, round(share, 6) AS share FROM dist")
def _(spark, d):
    return X.state_distribution(fx.ev_all(spark, d))


@query("xs_entropy", DIST + ", h AS (SELECT pos, sum(weight) AS n_valid, -sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END) AS h FROM dist GROUP BY pos) SELECT pos, n_valid, round(h / ln(5), 6) AS entropy, round(exp(h), 6) AS effective_states FROM h")
def _(spark, d):
    return X.entropy_by_position(fx.ev_all(spark, d))


@query("xs_modal_state", DIST + " SELECT pos, arg_max(code, (share, -code)) AS code, round(max(share), 6) AS share FROM dist GROUP BY pos")
def _(spark, d):
    return X.modal_states(fx.ev_all(spark, d))


@query("xs_mean_time", f"WITH {EV}, n AS (SELECT DISTINCT id FROM p), t AS (SELECT id, CAST(c AS INT) AS code, (SELECT count(*) FROM p WHERE p.id = n.id AND s = c) AS t FROM n, (SELECT unnest(range(1, 6)) AS c)), a AS (SELECT code, avg(t) AS m, var_samp(t) AS v, count(*) AS n FROM t GROUP BY code) SELECT code, round(m, 6) AS mean, round(v, 6) AS variance, round(sqrt(v), 6) AS sd, round(sqrt(v / n), 6) AS se FROM a")
def _(spark, d):
    return X.mean_time(fx.ev_all(spark, d))


@query("freq_sequences_topk", f"WITH {fx.SQL['ord_status']}, a AS (SELECT id, list(CAST(s AS INT) ORDER BY pos) AS q FROM p GROUP BY id), u AS (SELECT q, CAST(count(*) AS DOUBLE) AS weight FROM a GROUP BY q) SELECT array_to_string(q, '-') AS seq, weight, round(weight / (SELECT count(*) FROM a), 6) AS share FROM u ORDER BY weight DESC, q LIMIT 10")
def _(spark, d):
    return X.most_frequent(fx.ord_status(spark, d)).withColumn("seq", F.array_join(F.col("seq").cast("array<string>"), "-"))


@query("uniqueness_rate", f"WITH {fx.SQL['ord_status']}, a AS (SELECT id, list(s ORDER BY pos) AS q FROM p GROUP BY id) SELECT count(*) AS n, count(DISTINCT q) AS n_unique, round(count(DISTINCT q) / count(*), 6) AS rate FROM a")
def _(spark, d):
    return Q.uniqueness(fx.ord_status(spark, d))


@query("concatenated_sequences", f"WITH {fx.SQL['conv_roles']} SELECT id, string_agg(['assistant', 'system', 'user'][s], '-' ORDER BY pos) AS text FROM p GROUP BY id")
def _(spark, d):
    return Q.concatenated(fx.conv_roles(spark, d))


@query("cross_table", f"WITH {EV}, {fx.SQL['bands_all']} SELECT ['click', 'error', 'purchase', 'signup', 'view'][p.s] AS state_a, ['high', 'low', 'mid'][p2.s] AS state_b, CAST(count(*) AS DOUBLE) AS weight FROM p JOIN p2 USING (id, pos) GROUP BY ALL")
def _(spark, d):
    return Q.cross_table(fx.ev_all(spark, d), fx.bands_all(spark, d))


@query("daily_panel", f"WITH {fx.SQL['ev_daily']} SELECT CAST(pos AS INT) AS pos, CAST(s AS INT) AS code, count(*) AS n FROM p GROUP BY ALL")
def _(spark, d):
    return fx.ev_daily(spark, d).long.groupBy("pos", "code").agg(F.count("*").alias("n"))


@query("recoded_states", f"WITH {EV} SELECT CASE WHEN s IN (1, 5) THEN 'browse' ELSE 'other' END AS state, count(*) AS n FROM p GROUP BY ALL")
def _(spark, d):
    new = Q.recode(fx.ev_all(spark, d), {"browse": ["click", "view"]}, otherwise="other")
    return new.long.groupBy(new.state_of(F.col("code")).alias("state")).agg(F.count("*").alias("n"))


@query("missing_summary", "SELECT 'value' AS \"column\", count(*) FILTER (value IS NULL) AS n_missing, round(count(*) FILTER (value IS NULL) / count(*), 6) AS share FROM events UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), round(count(*) FILTER (event_type IS NULL) / count(*), 6) FROM events")
def _(spark, d):
    from trajectra.sources.tables import table

    return Q.missing_summary(table(spark, d, "events"), ["value", "event_type"])


TR = f"WITH {EV}, m AS (SELECT id, pos, s AS s1, lead(s) OVER (PARTITION BY id ORDER BY pos) AS s2 FROM p), c AS (SELECT s1, s2, count(*) AS n FROM m WHERE s2 IS NOT NULL GROUP BY ALL), r AS (SELECT s1, s2, n / sum(n) OVER (PARTITION BY s1) AS rate FROM c), ab AS (SELECT CAST(a AS INT) AS s1, CAST(b AS INT) AS s2 FROM (SELECT unnest(range(1, 6)) AS a), (SELECT unnest(range(1, 6)) AS b))"
#: The same over the daily panel, which has a sixth state for missing.
TR6 = TR.replace(EV, fx.SQL["ev_daily"]).replace("range(1, 6)", "range(1, 7)")


@query("transition_rates", TR + " SELECT CAST(s1 AS INT) AS s1, CAST(s2 AS INT) AS s2, round(rate, 6) AS rate FROM r")
def _(spark, d):
    return T.transition_rates(fx.ev_all(spark, d))


@query("transition_rates_by_time", TR + ", ct AS (SELECT pos, s1, s2, count(*) AS n FROM m WHERE s2 IS NOT NULL GROUP BY ALL) SELECT CAST(pos AS INT) AS pos, CAST(s1 AS INT) AS s1, CAST(s2 AS INT) AS s2, round(n / sum(n) OVER (PARTITION BY pos, s1), 6) AS rate FROM ct")
def _(spark, d):
    return T.transition_rates(fx.ev_all(spark, d), by_time=True)


@query("subcost_rate", TR + " SELECT ab.s1, ab.s2, round(CASE WHEN ab.s1 = ab.s2 THEN 0 ELSE 2 - coalesce(x.rate, 0) - coalesce(y.rate, 0) END, 6) AS cost FROM ab LEFT JOIN r x ON x.s1 = ab.s1 AND x.s2 = ab.s2 LEFT JOIN r y ON y.s1 = ab.s2 AND y.s2 = ab.s1")
def _(spark, d):
    return T.rate_costs(fx.ev_all(spark, d))


@query("subcost_rate_by_time", TR6 + """, ct AS (SELECT pos, s1, s2, count(*) AS n FROM m WHERE s2 IS NOT NULL GROUP BY ALL), rt AS (SELECT pos, s1, s2, n / sum(n) OVER (PARTITION BY pos, s1) AS rate FROM ct),
 g AS (SELECT CAST(t AS INT) AS pos, s1, s2 FROM ab, (SELECT unnest(range(1, 32)) AS t)),
 q AS (SELECT g.*, coalesce(a.rate, 0) + coalesce(b.rate, 0) + coalesce(c.rate, 0) + coalesce(e.rate, 0) AS x FROM g
  LEFT JOIN rt a ON a.pos = g.pos AND a.s1 = g.s1 AND a.s2 = g.s2 LEFT JOIN rt b ON b.pos = g.pos AND b.s1 = g.s2 AND b.s2 = g.s1
  LEFT JOIN rt c ON c.pos = g.pos - 1 AND c.s1 = g.s1 AND c.s2 = g.s2 LEFT JOIN rt e ON e.pos = g.pos - 1 AND e.s1 = g.s2 AND e.s2 = g.s1)
 SELECT pos, s1, s2, round(CASE WHEN s1 = s2 THEN 0 ELSE greatest(0, 4 - CASE WHEN pos IN (1, 31) THEN 2 * x ELSE x END) END, 6) AS cost FROM q""")
def _(spark, d):
    return T.rate_costs_by_time(fx.ev_daily(spark, d), fx.DAYS)


@query("subcost_future", TR + ", ms AS (SELECT s2, sum(rate) AS mass FROM r GROUP BY s2), f AS (SELECT ab.s1, ab.s2, t FROM ab, (SELECT unnest(range(1, 6)) AS t)) SELECT f.s1, f.s2, round(sqrt(sum((coalesce(x.rate, 0) - coalesce(y.rate, 0)) ** 2 / mass)), 6) AS cost FROM f LEFT JOIN r x ON x.s1 = f.s1 AND x.s2 = t LEFT JOIN r y ON y.s1 = f.s2 AND y.s2 = t JOIN ms ON ms.s2 = t GROUP BY f.s1, f.s2")
def _(spark, d):
    return T.future_costs(fx.ev_all(spark, d))


@query("subcost_indels", f"WITH {EV}, n AS (SELECT s, count(*) / (SELECT count(*) FROM p) AS f FROM p GROUP BY s) SELECT CAST(a.s AS INT) AS s1, CAST(b.s AS INT) AS s2, round(CASE WHEN a.s = b.s THEN 0 ELSE 1 / a.f + 1 / b.f END, 6) AS cost FROM n a, n b")
def _(spark, d):
    return T.indel_costs(fx.ev_all(spark, d))


@query("subcost_indels_log", f"WITH {EV}, n AS (SELECT s, count(*) / (SELECT count(*) FROM p) AS f FROM p GROUP BY s) SELECT CAST(a.s AS INT) AS s1, CAST(b.s AS INT) AS s2, round(CASE WHEN a.s = b.s THEN 0 ELSE ln(2 / (1 + a.f)) + ln(2 / (1 + b.f)) END, 6) AS cost FROM n a, n b")
def _(spark, d):
    return T.indel_costs(fx.ev_all(spark, d), log=True)


@query("subcost_features", f"WITH f(s, x, y) AS (VALUES (1, 1.0, 0.0), (2, 0.0, 1.0), (3, 5.0, 0.0), (4, 3.0, 1.0), (5, 2.0, 0.0)) SELECT a.s AS s1, b.s AS s2, round(0.5 * abs(a.x - b.x) / 5 + 0.5 * abs(a.y - b.y), 6) AS cost FROM f a, f b")
def _(spark, d):
    return T.feature_costs(fx.ev_all(spark, d), {"x": [1.0, 0.0, 5.0, 3.0, 2.0], "y": [0.0, 1.0, 0.0, 1.0, 0.0]})


@query("described", f"WITH {fx.SQL['ev_daily']}, a AS (SELECT id, list(s ORDER BY pos) AS q FROM p GROUP BY id) SELECT (SELECT count(*) FROM a) AS n, (SELECT count(DISTINCT q) FROM a) AS n_unique, CAST(6 AS INT) AS n_states, (SELECT count(*) FROM p) AS n_positions, CAST((SELECT min(len(q)) FROM a) AS INT) AS shortest, CAST((SELECT max(len(q)) FROM a) AS INT) AS longest, (SELECT count(*) FILTER (s = 6) FROM p) AS n_missing")
def _(spark, d):
    return Q.describe(fx.ev_daily(spark, d))


@query("cut_prefixes", f"WITH {fx.SQL['ord_seq']}, c AS (SELECT *, count(*) FILTER (s < 2) OVER (PARTITION BY id ORDER BY pos) AS low FROM p) SELECT id, coalesce(string_agg(CAST(s AS VARCHAR), '-' ORDER BY pos) FILTER (low = 0), '') AS seq FROM c GROUP BY id")
def _(spark, d):
    return Q.cut_prefixes(fx.ord_seq(spark, d), 2).select("id", F.array_join(F.col("seq").cast("array<string>"), "-").alias("seq"))


@query("spells_between_gaps", f"WITH {fx.SQL['ev_daily']}, k AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER w OR pos - 1 IS DISTINCT FROM lag(pos) OVER w THEN 1 ELSE 0 END AS c FROM p WHERE s <> 6 WINDOW w AS (PARTITION BY id ORDER BY pos)), n AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY pos) AS k FROM k) SELECT id, CAST(k AS INT) AS spell, CAST(any_value(s) AS INT) AS code, CAST(min(pos) AS INT) AS begin, CAST(count(*) AS INT) AS dur FROM n GROUP BY id, k")
def _(spark, d):
    return Q.spells_between_gaps(fx.ev_daily(spark, d))


def _neighbours(spark, d):
    """Customers next to each other by number."""
    frame = fx.ord_seq(spark, d)
    ids = frame.arrays.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    return frame, ids.join(frame.arrays.select(F.col("id").alias("j")), "j", "left_semi")


NEXT = f"WITH RECURSIVE {fx.SQL['ord_seq']}, a AS (SELECT id, list(s ORDER BY pos) AS q FROM p GROUP BY id), pr AS (SELECT a.id AS i, b.id AS j, a.q AS x, b.q AS y FROM a JOIN a b ON b.id = a.id + 1)"
STEP = "list_reduce(list_prepend([{first}], list_transform(range(1, len(y) + 1), lambda c: [{best}])), lambda a, b: list_append(a, {join}))"


@query("common_lengths", NEXT + ", dp AS (SELECT i, j, x, y, CAST(0 AS BIGINT) AS r, list_transform(range(0, len(y) + 1), lambda c: CAST(0 AS BIGINT)) AS row FROM pr UNION ALL SELECT i, j, x, y, r + 1, " + STEP.format(first="CAST(0 AS BIGINT)", best="greatest(row[c + 1], CASE WHEN x[r + 1] = y[c] THEN row[c] + 1 ELSE 0 END)", join="greatest(b[1], a[len(a)])") + " FROM dp WHERE r < len(x)) SELECT i, j, CAST(coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda t: x[t] <> y[t])) - 1, least(len(x), len(y))) AS INT) AS prefix, CAST(row[len(y) + 1] AS INT) AS subsequence FROM dp WHERE r = len(x)")
def _(spark, d):
    return Q.common_lengths(*_neighbours(spark, d))


@query("alignment_costs", NEXT + ", dp AS (SELECT i, j, x, y, CAST(0 AS BIGINT) AS r, list_transform(range(0, len(y) + 1), lambda c: c * 1.0::DOUBLE) AS row FROM pr UNION ALL SELECT i, j, x, y, r + 1, " + STEP.format(first="(r + 1) * 1.0::DOUBLE", best="least(row[c + 1] + 1.0, row[c] + CASE WHEN x[r + 1] = y[c] THEN 0 ELSE 1.5 END)", join="least(b[1], a[len(a)] + 1.0)") + " FROM dp WHERE r < len(x)) SELECT i, j, CAST(len(x) AS BIGINT) AS n_x, CAST(len(y) AS BIGINT) AS n_y, row[len(y) + 1] AS cost FROM dp WHERE r = len(x)")
def _(spark, d):
    """The steps' sums: costs of a cheapest alignment, and all items of both rows, once each."""
    frame, pairs = _neighbours(spark, d)
    steps = Q.alignments(frame, pairs, [[0.0 if a == b else 1.5 for b in range(5)] for a in range(5)], 1.0)
    return steps.groupBy("i", "j").agg(F.count("a").alias("n_x"), F.count("b").alias("n_y"), F.sum("cost").alias("cost"))


@query("alignments")
def _(spark, d):
    frame, pairs = _neighbours(spark, d)
    return Q.alignments(frame, pairs, [[0.0 if a == b else 1.5 for b in range(5)] for a in range(5)], 1.0)


@query("separated_values", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    """Nations written as separated values and read back."""
    import uuid

    from trajectra.operators.tables import own_folder
    from trajectra.sources import tables

    path = f"{own_folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.write(tables.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "csv")
    return tables.read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long")
