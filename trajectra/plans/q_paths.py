"""Queries on prefixes and suffixes, and on event histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import prefixes as P
from trajectra.operators import survival as H
from trajectra.sources import fixtures as fx
from trajectra.sources.tables import table

from .rounding import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


EV, ORD, SP = fx.SQL["ev_all"], fx.SQL["ord_status"], fx.SPELLS_SQL
PRE = "pre AS (SELECT id, pos, string_agg(s, '-') OVER (PARTITION BY id ORDER BY pos) AS path, CASE WHEN pos = 1 THEN '' ELSE string_agg(s, '-') OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM p)"
SUF = "suf AS (SELECT id, pos, count(*) OVER (PARTITION BY id ORDER BY pos DESC) AS depth, string_agg(s, '-') OVER (PARTITION BY id ORDER BY pos DESC) AS path FROM p)"
RAR = "freq AS (SELECT id, pos, count(*) OVER (PARTITION BY pos, path) AS freq, count(*) OVER (PARTITION BY pos) AS n FROM {t}), rar AS (SELECT id, pos, freq, -ln(freq / n + 1e-10) AS r FROM freq), zs AS (SELECT *, CASE WHEN max(r) OVER (PARTITION BY pos) > min(r) OVER (PARTITION BY pos) THEN (r - avg(r) OVER (PARTITION BY pos)) / stddev_samp(r) OVER (PARTITION BY pos) END AS z FROM rar)"


@query("prefix_counts", f"WITH {ORD}, {PRE} SELECT CAST(pos AS INT) AS depth, count(DISTINCT path) AS n FROM pre GROUP BY pos")
def _(spark, d):
    return P.distinct_counts(fx.ord_status(spark, d))


@query("suffix_counts", f"WITH {ORD}, {SUF} SELECT CAST(depth AS INT) AS depth, count(DISTINCT path) AS n FROM suf GROUP BY depth")
def _(spark, d):
    return P.distinct_counts(fx.ord_status(spark, d), backward=True)


@query("spell_prefix_counts", f"WITH {ORD}, {SP}, sq AS (SELECT id, k, string_agg(s, '-') OVER (PARTITION BY id ORDER BY k) AS path FROM sp) SELECT CAST(k AS INT) AS depth, count(DISTINCT path) AS n FROM sq GROUP BY k")
def _(spark, d):
    return P.distinct_counts(fx.ord_status(spark, d), spells=True)


@query("substring_counts", f"WITH {ORD}, a AS (SELECT id, list(s ORDER BY pos) AS q FROM p GROUP BY id), x AS (SELECT q, n, unnest(range(1, len(q) + 2 - n)) AS i FROM a, (SELECT unnest(range(1, (SELECT max(len(q)) + 1 FROM a))) AS n) WHERE n <= len(q)) SELECT CAST(n AS INT) AS depth, count(DISTINCT q[i:i + n - 1]) AS n FROM x GROUP BY n".replace("AS n FROM x GROUP BY n", "AS cnt FROM x GROUP BY n").replace("AS cnt", "AS n"))
def _(spark, d):
    return P.substrings(fx.ord_status(spark, d))


@query("branching_factor", f"WITH {ORD}, {PRE}, c AS (SELECT pos, parent, count(DISTINCT path) AS n FROM pre GROUP BY ALL) SELECT CAST(pos AS INT) AS depth, round(CASE WHEN pos = 1 THEN 0 ELSE avg(n) END, 6) AS factor FROM c GROUP BY pos")
def _(spark, d):
    return P.branching(fx.ord_status(spark, d))


@query("js_divergence", f"WITH {EV}, n AS (SELECT pos, c AS s, count(*) FILTER (p.s = c) AS w FROM p, (SELECT unnest(range(1, 6)) AS c) GROUP BY pos, c), f AS (SELECT pos, s, w / sum(w) OVER (PARTITION BY pos) AS p FROM n), j AS (SELECT a.pos, a.p, coalesce(b.p, 0) AS q, (a.p + coalesce(b.p, 0)) / 2 AS m FROM f a LEFT JOIN f b ON b.pos = a.pos - 1 AND b.s = a.s) SELECT CAST(pos AS INT) AS pos, round(CASE WHEN pos = 1 THEN 0 ELSE sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2))) END, 6) AS distance FROM j GROUP BY pos")
def _(spark, d):
    return P.js_distance(fx.ev_all(spark, d))


@query("prefix_rarity", f"WITH {ORD}, {PRE}, {RAR.format(t='pre')} SELECT id, CAST(pos AS INT) AS pos, freq, round(r, 6) AS rarity, round(z, 6) AS z FROM zs")
def _(spark, d):
    return P.rarity(fx.ord_status(spark, d))


@query("suffix_rarity", f"WITH {ORD}, {SUF}, {RAR.format(t='suf')} SELECT id, CAST(pos AS INT) AS pos, freq, round(r, 6) AS rarity, round(z, 6) AS z FROM zs")
def _(spark, d):
    return P.rarity(fx.ord_status(spark, d), backward=True)


@query("path_uniqueness", f"WITH {ORD}, {PRE}, {RAR.format(t='pre')} SELECT id, round(sum(r), 6) AS score, count(*) FILTER (freq = 1) AS unique_positions FROM rar GROUP BY id")
def _(spark, d):
    return P.rarity_scores(fx.ord_status(spark, d))


LOW = "low AS (SELECT id, pos, CASE WHEN count(z) OVER w = {w} THEN min(z) OVER w END AS low FROM (SELECT * FROM zs WHERE pos >= {f}) WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {a} FOLLOWING))"


@query("standardized_rarity", f"WITH {ORD}, {PRE}, {RAR.format(t='pre')}, {LOW.format(w=2, f=2, a=1)} SELECT id, round(max(low), 6) AS score FROM low GROUP BY id")
def _(spark, d):
    return P.standardized_rarity(fx.ord_status(spark, d), first=2, window=2)


@query("first_divergence", f"WITH {ORD}, {PRE}, {RAR.format(t='pre')}, {LOW.format(w=2, f=2, a=1)}, x AS (SELECT id, min(pos) AS first_pos FROM low WHERE low > 1.0 GROUP BY id) SELECT id, first_pos IS NOT NULL AS diverged, CAST(first_pos AS INT) AS first_pos FROM (SELECT DISTINCT id FROM p) LEFT JOIN x USING (id)")
def _(spark, d):
    return P.first_divergence(fx.ord_status(spark, d), threshold=1.0)


@query("first_divergence_quantile", f"WITH {ORD}, {PRE}, {RAR.format(t='pre')}, {LOW.format(w=2, f=2, a=1)}, sc AS (SELECT id, max(low) AS s FROM low GROUP BY id), m AS (SELECT id, s FROM sc WHERE s >= (SELECT quantile_cont(s, 0.9) FROM sc)) SELECT id, m.id IS NOT NULL AS diverged, CAST((SELECT min(pos) FROM low WHERE low.id = i.id AND low.low = m.s) AS INT) AS first_pos FROM (SELECT DISTINCT id FROM p) i LEFT JOIN m USING (id)".replace("m.id IS NOT NULL", "m.s IS NOT NULL"))
def _(spark, d):
    return P.first_divergence(fx.ord_status(spark, d), method="quantile")


@query(
    "first_divergence_top",
    f"WITH {ORD}, {PRE}, {RAR.format(t='pre')}, {LOW.format(w=2, f=2, a=1)}, sc AS (SELECT id, max(low) AS s FROM low GROUP BY id), m AS (SELECT id, s FROM (SELECT *, row_number() OVER (ORDER BY s DESC NULLS LAST, id) AS k FROM sc) WHERE s IS NOT NULL AND k <= greatest(1, floor(0.1 * (SELECT count(DISTINCT id) FROM p)))) "
    "SELECT id, m.id IS NOT NULL AS diverged, CAST((SELECT min(pos) FROM low WHERE low.id = i.id AND low.low = m.s) AS INT) AS first_pos FROM (SELECT DISTINCT id FROM p) i LEFT JOIN m USING (id)",
)
def _(spark, d):
    return P.first_divergence(fx.ord_status(spark, d), method="top_proportion")


@query(
    "first_convergence",
    f"WITH {ORD}, {SUF}, {RAR.format(t='suf')}, zn AS (SELECT id, pos, -z AS z FROM zs), {LOW.format(w=2, f=2, a=1).replace('FROM zs', 'FROM zn')}, x AS (SELECT id, min(pos) AS first_pos FROM low WHERE low > 0.5 GROUP BY id) "
    "SELECT id, first_pos IS NOT NULL AS diverged, CAST(first_pos AS INT) AS first_pos FROM (SELECT DISTINCT id FROM p) LEFT JOIN x USING (id)",
)
def _(spark, d):
    return P.first_divergence(fx.ord_status(spark, d), backward=True, threshold=0.5)


PERSONS = "SELECT c_custkey AS id, CAST(1 + c_custkey % 9 AS INT) AS time, CAST(c_custkey % 2 AS INT) AS event, c_mktsegment AS segment FROM customer"


def _persons(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (1 + F.col("c_custkey") % 9).cast("int").alias("time"), (F.col("c_custkey") % 2).cast("int").alias("event"), F.col("c_mktsegment").alias("segment"))


@query("person_period", f"WITH h AS ({PERSONS}) SELECT id, segment, CAST(t AS INT) AS period, CASE WHEN t = time THEN event ELSE 0 END AS event FROM (SELECT *, unnest(range(1, time + 1)) AS t FROM h)")
def _(spark, d):
    return H.person_period(_persons(spark, d), "id", "time", "event")


@query("sequence_history", f"WITH {ORD}, h AS ({PERSONS}), a AS (SELECT id, list(s ORDER BY pos) AS q FROM p GROUP BY id), t AS (SELECT *, unnest(range(1, time + 1)) AS t FROM h) SELECT id, segment, CAST(t AS INT) AS period, CASE WHEN t = time THEN event ELSE 0 END AS event, array_to_string(q[1:t - 1], '-') AS past FROM t JOIN a USING (id)")
def _(spark, d):
    return H.sequence_history(_persons(spark, d), fx.ord_status(spark, d), "id", "time", "event").withColumn("past", F.array_join(F.col("past").cast("array<string>"), "-"))


SAMM = f"WITH {EV}, {SP}, a AS (SELECT id, list(s ORDER BY pos) AS q FROM p GROUP BY id), w AS (SELECT id, q, unnest(range(1, len(q) - 3)) AS t, len(q) - 4 AS last_t FROM a), x AS (SELECT id, t, q, last_t, (SELECT max(b) FROM sp WHERE sp.id = w.id AND b <= t) AS b FROM w)"


@query("moving_windows", SAMM + " SELECT id, CAST(t AS INT) AS time, array_to_string(q[t:t + 4], '-') AS states, CAST(b AS INT) AS begin, CAST(t - b + 1 AS INT) AS spell_time, q[t] <> q[t + 1] AS transition, t = last_t AS last_observed FROM x")
def _(spark, d):
    return H.moving_windows(fx.ev_all(spark, d), 5).withColumn("states", F.array_join(F.col("states").cast("array<string>"), "-"))


@query("windows_after_spell", SAMM + " SELECT id, CAST(t AS INT) AS time, array_to_string(q[t:t + 4], '-') AS states FROM x WHERE q[t] = 3 AND q[t + 1] <> 3")
def _(spark, d):
    return H.after_leaving(H.moving_windows(fx.ev_all(spark, d), 5), 3).select("id", "time", F.array_join(F.col("states").cast("array<string>"), "-").alias("states"))


@query("spell_survival", f"WITH {fx.SQL['ord_seq']}, {SP}, n AS (SELECT id, count(*) AS n FROM p GROUP BY id), r AS (SELECT CAST(s AS VARCHAR) AS stratum, d AS time, CASE WHEN b + d - 1 < n THEN 1.0 ELSE 0.0 END AS e FROM sp JOIN n USING (id)), c AS (SELECT stratum, time, CAST(count(*) AS DOUBLE) AS l, CAST(sum(e) AS DOUBLE) AS events FROM r GROUP BY ALL), k AS (SELECT *, sum(l) OVER (PARTITION BY stratum ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM c), v AS (SELECT *, max(CASE WHEN events >= at_risk THEN 1 ELSE 0 END) OVER w AS gone, sum(CASE WHEN events >= at_risk THEN 0 ELSE ln(1 - events / at_risk) END) OVER w AS ls, sum(CASE WHEN events >= at_risk THEN 0 ELSE events / (at_risk * (at_risk - events)) END) OVER w AS g FROM k WINDOW w AS (PARTITION BY stratum ORDER BY time)) SELECT stratum, CAST(time AS INT) AS time, at_risk, events, round(CASE WHEN gone = 1 THEN 0 ELSE exp(ls) END, 6) AS survival, round(CASE WHEN gone = 1 THEN 0 ELSE exp(ls) * sqrt(g) END, 6) AS se FROM v")
def _(spark, d):
    return H.spell_survival(fx.ord_seq(spark, d))


JS = "f AS (SELECT pos, s, w / sum(w) OVER (PARTITION BY pos) AS p FROM n), e AS (SELECT {edge}(pos) AS e FROM f), k AS (SELECT DISTINCT pos FROM f), g AS (SELECT k.pos, c AS s FROM k, (SELECT unnest(range(1, {k} + 1)) AS c)), j AS (SELECT g.pos, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q, (coalesce(a.p, 0) + coalesce(b.p, 0)) / 2 AS m FROM g LEFT JOIN f a ON a.pos = g.pos AND a.s = g.s LEFT JOIN f b ON b.pos = g.pos {sign} 1 AND b.s = g.s) SELECT CAST(pos AS INT) AS pos, round(CASE WHEN pos = (SELECT e FROM e) THEN 0 ELSE sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2))) END, 6) AS distance FROM j GROUP BY pos"


@query("js_convergence", f"WITH {EV}, n AS (SELECT pos, s, CAST(count(*) AS DOUBLE) AS w FROM p GROUP BY ALL), " + JS.format(edge="max", k=5, sign="+"))
def _(spark, d):
    return P.js_distance(fx.ev_all(spark, d), backward=True)


@query("spell_js_divergence", f"WITH {ORD}, {SP}, n AS (SELECT k AS pos, s, sum(sqrt(d)) AS w FROM sp GROUP BY ALL), " + JS.format(edge="min", k=3, sign="-"))
def _(spark, d):
    return P.spell_js_distance(fx.ord_status(spark, d), 0.5)


@query("spell_js_convergence", f"WITH {ORD}, {SP}, n AS (SELECT k AS pos, s, CAST(count(*) AS DOUBLE) AS w FROM sp GROUP BY ALL), " + JS.format(edge="max", k=3, sign="+"))
def _(spark, d):
    return P.spell_js_distance(fx.ord_status(spark, d), backward=True)


def _thirds(spark, d):
    return fx.ord_status(spark, d).arrays.select("id", (F.col("id") % 3).cast("int").alias("group"))


GRP = f"WITH {ORD}, {PRE}, freq AS (SELECT id, pos, id % 3 AS g, count(*) OVER (PARTITION BY id % 3, pos, path) AS freq, count(*) OVER (PARTITION BY id % 3, pos) AS n FROM pre), rar AS (SELECT id, g, freq, -ln(freq / n + 1e-10) AS r FROM freq), sc AS (SELECT id, any_value(g) AS g, sum(r) AS score, count(*) FILTER (freq = 1) AS unique_positions FROM rar GROUP BY id)"


@query("path_uniqueness_by_group", GRP + " SELECT id, round(score, 6) AS score, unique_positions FROM sc")
def _(spark, d):
    return P.rarity_scores(fx.ord_status(spark, d), group=_thirds(spark, d))


@query("score_thresholds", GRP + ' SELECT CAST(g AS INT) AS "group", count(*) AS n, round(quantile_cont(score, 0.9), 6) AS threshold FROM sc GROUP BY g')
def _(spark, d):
    group = _thirds(spark, d)
    return P.score_thresholds(P.rarity_scores(fx.ord_status(spark, d), group=group), group)


SPR = f"WITH {ORD}, {SP}, sq AS (SELECT id, k AS pos, string_agg(s, '-') OVER (PARTITION BY id ORDER BY k) AS path FROM sp), {RAR.format(t='sq')}"


@query("spell_prefix_rarity", SPR + " SELECT id, CAST(pos AS INT) AS pos, freq, round(r, 6) AS rarity, round(z, 6) AS z FROM zs")
def _(spark, d):
    return P.rarity(fx.ord_status(spark, d), spells=True)


@query("spell_path_uniqueness", SPR + " SELECT id, round(sum(r), 6) AS score, count(*) FILTER (freq = 1) AS unique_positions FROM rar GROUP BY id")
def _(spark, d):
    return P.rarity_scores(fx.ord_status(spark, d), spells=True)


@query("rarity_diagnostics", f"WITH {ORD}, {PRE}, {RAR.format(t='pre')} SELECT CAST(pos AS INT) AS pos, count(*) AS n, round(avg(r), 6) AS mean, round(CASE WHEN max(r) = min(r) THEN 0 ELSE stddev_samp(r) END, 6) AS sd, round(min(r), 6) AS least, round(max(r), 6) AS most, count(*) FILTER (freq = 1) AS n_unique FROM zs GROUP BY pos HAVING count(*) > 1")
def _(spark, d):
    return P.rarity_diagnostics(fx.ord_status(spark, d)).where("n > 1")
