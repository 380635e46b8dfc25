"""Queries on event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import event_counts as C
from trajectra.operators import events as E
from trajectra.operators import situations as G
from trajectra.sources import fixtures as fx

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


def _tse(spark, d):
    return E.events(fx.tse(spark, d), "id", "ts", "event")


#: CTE "v" (id, ts, event), time in hours.
TSE = "WITH v AS (SELECT DISTINCT user_id AS id, epoch_us(ts) / 3.6e9 AS ts, event_type AS event FROM events)"


@query("event_transitions", TSE + ", m AS (SELECT event AS e1, lead(event) OVER (PARTITION BY id ORDER BY ts, event) AS e2 FROM v), c AS (SELECT e1, e2, count(*) AS n FROM m WHERE e2 IS NOT NULL GROUP BY ALL) SELECT e1, e2, n, round(n / sum(n) OVER (PARTITION BY e1), 6) AS rate FROM c")
def _(spark, d):
    return E.event_transitions(_tse(spark, d))


for _kind, _label in (("transition", "last || '>' || s"), ("state", "s"), ("period", "'end' || last || ',begin' || s")):

    @query(f"events_from_states_{_kind}", f"WITH {fx.SQL['ord_status']}, n AS (SELECT id, pos, ['F', 'O', 'P'][s] AS s FROM p), l AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY pos) AS last FROM n) SELECT id, CAST(pos - 1 AS DOUBLE) AS ts, CASE WHEN last IS NULL THEN {'s' if _kind != 'period' else chr(39) + 'begin' + chr(39) + ' || s'} ELSE {_label} END AS event FROM l WHERE last IS NULL OR last <> s")
    def _(spark, d, kind=_kind):
        return E.from_states(fx.ord_status(spark, d), kind)


def _longer(n: int) -> str:
    """CTE of the distinct (id, events so far, last time) of patterns of n events one after another."""
    return f"o{n} AS (SELECT DISTINCT o.id, o.pattern || '-(' || v.event || ')' AS pattern, v.ts FROM o{n - 1} o JOIN v ON v.id = o.id AND v.ts > o.ts)"


#: Up to five events in a row; on sf0.01 no pattern of five has this support, a fifteenth of the customers.
FREQUENT = f"WITH {fx.SQL['ord_status']}, n AS (SELECT id, pos, ['F', 'O', 'P'][s] AS s FROM p), l AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY pos) AS last FROM n), v AS (SELECT id, pos AS ts, CASE WHEN last IS NULL THEN s ELSE last || '>' || s END AS event FROM l WHERE last IS NULL OR last <> s), o1 AS (SELECT DISTINCT id, '(' || event || ')' AS pattern, ts FROM v), {', '.join(map(_longer, range(2, 6)))}, o AS ({' UNION ALL '.join(f'SELECT pattern, {n} AS length, count(DISTINCT id) AS support FROM o{n} GROUP BY pattern' for n in range(1, 6))}) SELECT pattern, CAST(length AS INT) AS length, CAST(support AS DOUBLE) AS support, round(support / (SELECT count(DISTINCT id) FROM v), 6) AS share FROM o WHERE support >= (SELECT count(DISTINCT id) FROM v) / 15"


@query("frequent_subsequences", FREQUENT)
def _(spark, d):
    frame = fx.ord_status(spark, d)
    return E.frequent_subsequences(E.from_states(frame), frame.long.select("id").distinct().count() / 15)


@query("frequent_subsequences_gap", TSE + ", o AS (SELECT '(' || event || ')' AS pattern, 1 AS length, count(DISTINCT id) AS support FROM v GROUP BY ALL UNION ALL SELECT '(' || a.event || ')-(' || b.event || ')', 2, count(DISTINCT a.id) FROM v a JOIN v b ON a.id = b.id AND a.ts < b.ts AND b.ts - a.ts <= 3.0 GROUP BY ALL UNION ALL SELECT '(' || a.event || ',' || b.event || ')', 2, count(DISTINCT a.id) FROM v a JOIN v b ON a.id = b.id AND a.ts = b.ts AND a.event < b.event GROUP BY ALL) SELECT pattern, CAST(length AS INT) AS length, CAST(support AS DOUBLE) AS support, round(support / (SELECT count(DISTINCT id) FROM v), 6) AS share FROM o WHERE support >= 10")
def _(spark, d):
    return E.frequent_subsequences(_tse(spark, d), 10, longest=2, constraint=E.Constraint(max_gap=3.0))


@query("frequent_subsequences_gap_whole")
def _(spark, d):
    """Of any length; the SQL of ``frequent_subsequences_gap`` ends at two events."""
    return E.frequent_subsequences(_tse(spark, d), 10, constraint=E.Constraint(max_gap=3.0))


COUNTS = TSE + ", o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event) AS i FROM v), k AS (SELECT DISTINCT a.id, a.i FROM o a JOIN o b ON a.id = b.id AND b.i > a.i WHERE a.event = 'view' AND b.event = 'purchase' AND b.ts - a.ts <= 24), k1 AS (SELECT id, i FROM o WHERE event = 'error'), ids AS (SELECT DISTINCT id FROM v), c AS (SELECT id, '(view)-(purchase)' AS pattern, (SELECT count(*) FROM k WHERE k.id = ids.id) AS n FROM ids UNION ALL SELECT id, '(error)', (SELECT count(*) FROM k1 WHERE k1.id = ids.id) FROM ids)"


@query("subsequence_counts", COUNTS + " SELECT id, pattern, CAST(n AS INT) AS n FROM c")
def _(spark, d):
    return E.count_occurrences(_tse(spark, d), [["view", "purchase"], ["error"]], E.Constraint(window=24.0))


@query("subsequence_containment", COUNTS + " SELECT id, n > 0 AS contained FROM c WHERE pattern = '(view)-(purchase)'")
def _(spark, d):
    return E.contains(_tse(spark, d), ["view", "purchase"], E.Constraint(window=24.0))


@query("subsequence_groups", f"WITH {fx.SQL['ord_status']}, a AS (SELECT id, string_agg(['F', 'O', 'P'][s], '' ORDER BY pos) AS q FROM p GROUP BY id), f AS (SELECT id % 3 AS g, pt, CASE WHEN contains(regexp_replace(q, '(F+)', 'F', 'g'), 'FO') THEN 1 ELSE 0 END AS a, CASE WHEN contains(q, 'OP') THEN 1 ELSE 0 END AS b FROM a, (SELECT unnest(['(F>O)', '(O>P)']) AS pt)), t AS (SELECT pt AS pattern, g, CAST(sum(CASE WHEN pt = '(F>O)' THEN a ELSE b END) AS DOUBLE) AS y, count(*) AS n FROM f GROUP BY ALL), u AS (SELECT *, sum(y) OVER (PARTITION BY pattern) AS ay, sum(n) OVER (PARTITION BY pattern) AS an FROM t) SELECT pattern, round(sum((y - ay * n / an) ** 2 / (ay * n / an) + (y - ay * n / an) ** 2 / ((an - ay) * n / an)), 6) AS statistic FROM u GROUP BY pattern")
def _(spark, d):
    frame = fx.ord_status(spark, d)
    counts = E.count_occurrences(E.from_states(frame), [["F>O"], ["O>P"]], presence=True)
    return E.compare_groups(counts, frame.long.select("id", (F.col("id") % 3).alias("group")).distinct()).drop("p_value")


@query("situation_rates", f"WITH {fx.SQL['ord_status']}, n AS (SELECT pos, s, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT a.pos AS p1, a.s AS s1, c.pos AS p2, c.s AS s2, count(*) AS w FROM p a JOIN p c ON a.id = c.id AND c.pos > a.pos GROUP BY ALL) SELECT CAST(p1 AS INT) AS pos1, CAST(s1 AS INT) AS s1, CAST(p2 AS INT) AS pos2, CAST(s2 AS INT) AS s2, round(w / n, 6) AS rate, round(w / n / (p2 - p1 + 1), 6) AS discounted FROM b JOIN n ON n.pos = p1 AND n.s = s1")
def _(spark, d):
    return E.situation_rates(fx.ord_status(spark, d))


@query(
    "situation_distances",
    f"""WITH {fx.SQL['ord_status']}, n AS (SELECT pos, s, count(*) AS n FROM p GROUP BY ALL), f AS (SELECT pos, s, n / sum(n) OVER (PARTITION BY pos) AS f FROM n),
r AS (SELECT a.s AS u, c.pos, c.s AS t, count(*) / any_value(n.n) / c.pos AS v FROM p a JOIN p c ON a.id = c.id AND a.pos = 1 AND c.pos > 1 JOIN n ON n.pos = 1 AND n.s = a.s GROUP BY a.s, c.pos, c.s),
x AS (SELECT g.u, f.pos, f.s AS t, f.f, coalesce(r.v, 0) AS v FROM (SELECT DISTINCT u FROM r) g CROSS JOIN f LEFT JOIN r ON r.u = g.u AND r.pos = f.pos AND r.t = f.s WHERE f.pos > 1)
SELECT CAST(a.u AS INT) AS s1, CAST(b.u AS INT) AS s2, round(sqrt(sum((a.v - b.v) * (a.v - b.v) / a.f)), 6) AS d FROM x a JOIN x b ON a.pos = b.pos AND a.t = b.t WHERE a.u < b.u GROUP BY ALL""",
)
def _(spark, d):
    return E.situation_distances(fx.ord_status(spark, d), 1)


#: CTEs: days on which events happen, the starts "o" (id, pattern, s, e) of two patterns with their earliest ends, and minimal windows "m".
DAILY = """WITH v AS (SELECT DISTINCT user_id AS id, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS DOUBLE) AS ts, event_type AS event FROM events),
twice AS (SELECT a.id, a.ts FROM v a JOIN v b ON a.id = b.id AND a.ts = b.ts WHERE a.event = 'click' AND b.event = 'view'),
o AS (SELECT a.id, '(view)-(purchase)' AS pattern, a.ts AS s, min(b.ts) AS e FROM v a JOIN v b ON a.id = b.id AND b.ts > a.ts AND b.ts - a.ts <= 5 WHERE a.event = 'view' AND b.event = 'purchase' GROUP BY ALL
  UNION ALL SELECT a.id, '(click,view)-(view)-(error)', a.ts, min(c.ts) FROM twice a JOIN v b ON a.id = b.id AND b.ts > a.ts AND b.ts - a.ts <= 5 JOIN v c ON a.id = c.id AND c.ts > b.ts AND c.ts - b.ts <= 5 WHERE b.event = 'view' AND c.event = 'error' AND c.ts - a.ts <= 9 GROUP BY ALL),
m AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.id = o.id AND x.pattern = o.pattern AND x.s > o.s AND x.e <= o.e))"""
DAILY_PATTERNS, DAILY_LIMIT = ("(view)-(purchase)", "(click,view)-(view)-(error)"), E.Constraint(max_gap=5.0, window=9.0)


def _daily(spark, d):
    day = F.expr("cast(datediff(cast(ts AS date), DATE '2020-01-01') AS double)")
    return E.events(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), day.alias("ts"), F.col("event_type").alias("event")), "id", "ts", "event")


@query(
    "event_window_counts",
    f"""{DAILY.replace("WITH v", "WITH RECURSIVE v")}, g AS (SELECT DISTINCT id, pattern, unnest(range(CAST(ceil((e - 7) / 2) AS BIGINT), CAST(floor(s / 2) AS BIGINT) + 1)) AS g FROM m),
d AS (SELECT id, pattern, max(s) AS s FROM m GROUP BY ALL UNION ALL SELECT id, pattern, s FROM (SELECT m.id, m.pattern, max(m.s) AS s FROM d JOIN m ON m.id = d.id AND m.pattern = d.pattern AND m.e < d.s GROUP BY ALL)),
i AS (SELECT id, pattern FROM (SELECT DISTINCT id FROM v), (VALUES ('(view)-(purchase)'), ('(click,view)-(view)-(error)')) p(pattern))
SELECT i.id, i.pattern, (SELECT count(*) FROM o WHERE o.id = i.id AND o.pattern = i.pattern) AS starts, (SELECT count(*) FROM m WHERE m.id = i.id AND m.pattern = i.pattern) AS minimal,
  (SELECT count(*) FROM d WHERE d.id = i.id AND d.pattern = i.pattern) AS disjoint, (SELECT count(*) FROM g WHERE g.id = i.id AND g.pattern = i.pattern) AS windows FROM i""",
)
def _(spark, d):
    """Windows of a week that begin every other day."""
    return C.count_windows(_daily(spark, d), DAILY_PATTERNS, 7.0, 2.0, DAILY_LIMIT)


@query("event_minimal_windows", f"""{DAILY} SELECT o.id, o.pattern, o.s AS start, o.e AS "end", m.s IS NOT NULL AS minimal FROM o LEFT JOIN m ON m.id = o.id AND m.pattern = o.pattern AND m.s = o.s""")
def _(spark, d):
    return C.occurrence_windows(_daily(spark, d), DAILY_PATTERNS, DAILY_LIMIT)


#: CTEs to the double-centred squared distances "z" (i, j, b) of situations' discounted futures.
_SITUATIONS = f"""WITH {fx.SQL["ord_status"]}, n AS (SELECT pos, s, count(*) AS n, dense_rank() OVER (ORDER BY pos, s) AS i FROM p GROUP BY pos, s),
k AS (SELECT p.id, p.pos, n.i FROM p JOIN n USING (pos, s)),
r AS (SELECT a.i, b.i AS j, count(*) / any_value(n.n) / (any_value(b.pos) - any_value(a.pos) + 1) AS r FROM k a JOIN k b ON a.id = b.id AND b.i >= a.i JOIN n ON n.i = a.i GROUP BY a.i, b.i),
f AS (SELECT i, j, r / sum(r) OVER (PARTITION BY i) AS f FROM r),
g AS (SELECT x.i AS i, y.i AS j, coalesce(f.f, 0) AS f FROM n x CROSS JOIN n y LEFT JOIN f ON f.i = x.i AND f.j = y.i),
t AS (SELECT j, sum(f) AS t FROM g GROUP BY j),
d AS (SELECT a.i AS i, b.i AS j, sum((a.f - b.f) * (a.f - b.f) / t.t) AS d FROM g a JOIN g b ON a.j = b.j JOIN t ON t.j = a.j GROUP BY ALL),
z AS (SELECT i, j, -0.5 * (d - avg(d) OVER (PARTITION BY i) - avg(d) OVER (PARTITION BY j) + avg(d) OVER ()) AS b FROM d)"""


@query("situation_correlations", f"{_SITUATIONS} SELECT CAST(x.pos AS INT) AS pos1, CAST(x.s AS INT) AS s1, CAST(y.pos AS INT) AS pos2, CAST(y.s AS INT) AS s2, round(corr(a.b, c.b), 6) AS r FROM z a JOIN z c ON a.i = c.i JOIN n x ON x.i = a.j JOIN n y ON y.i = c.j WHERE a.j <= c.j GROUP BY ALL")
def _(spark, d):
    return G.situation_correlations(fx.ord_status(spark, d))


@query("situation_components")
def _(spark, d):
    return G.situation_components(fx.ord_status(spark, d), components=2)


@query("sequence_coordinates")
def _(spark, d):
    found = G.sequence_coordinates(fx.ord_status(spark, d), components=2)
    return found.select("id", F.col("coordinates")[0].alias("first"), F.col("coordinates")[1].alias("second"))
