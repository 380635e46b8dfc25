"""Queries that compare groups: gaps over clusters of sequences, and associations by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import decomposition as D
from trajectra.operators import positions as P
from trajectra.operators.sequences import SequenceFrame
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


def _typed_orders(spark, d):
    """(id, orders, g, kind): customers' numbers of orders, by even and odd ids, and the state of their first order."""
    frame = fx.ord_status(spark, d)
    first = frame.long.groupBy("id").agg(F.count("*").cast("double").alias("orders"), F.min_by("code", "pos").alias("code"))
    return first.select("id", "orders", (F.col("id") % 2).cast("int").alias("g"), frame.state_of(F.col("code")).alias("kind"))


#: CTEs: customers "r", means "m" and shares of each kind by group, normalized coefficients "b" (kinds alone: means less their mean), and owners "w".
_SQL = f"""WITH {fx.SQL["ord_status"]},
r AS (SELECT id, CAST(count(*) AS DOUBLE) AS y, id % 2 AS g, ['F', 'O', 'P'][arg_min(s, pos)] AS kind FROM p GROUP BY id),
t AS (SELECT g, count(*) AS n, avg(y) AS y FROM r GROUP BY g),
m AS (SELECT g, kind, count(*) / any_value(t.n) AS share, avg(r.y) AS y FROM r JOIN t USING (g) GROUP BY g, kind),
b AS (SELECT g, kind, share, y - avg(y) OVER (PARTITION BY g) AS b, avg(y) OVER (PARTITION BY g) AS a FROM m),
w AS (SELECT z.kind, z.share AS p0, o.share AS p1, z.b AS b0, o.b AS b1, z.a AS a0, o.a AS a1, 100 * abs(z.share - o.share) / greatest(z.share, o.share) AS short FROM b z JOIN b o ON z.kind = o.kind WHERE z.g = 0 AND o.g = 1),
x AS (SELECT *, CASE WHEN short > 3 AND p1 > p0 THEN b1 ELSE b0 END AS star FROM w)"""


@query(
    "cluster_gap_decomposition",
    f"""{_SQL}, c AS (SELECT kind, (p0 - p1) * star AS explained, p0 * (b0 - star) + p1 * (star - b1) AS returns, a0 - a1 AS constant FROM x)
SELECT 'gap' AS component, NULL AS term, round((SELECT y FROM t WHERE g = 0) - (SELECT y FROM t WHERE g = 1), 6) AS value
UNION ALL SELECT 'constant', NULL, round(any_value(constant), 6) FROM c UNION ALL SELECT 'explained', NULL, round(sum(explained), 6) FROM c UNION ALL SELECT 'returns', NULL, round(sum(returns), 6) FROM c
UNION ALL SELECT 'explained', 'kind=' || kind, round(explained, 6) FROM c UNION ALL SELECT 'returns', 'kind=' || kind, round(returns, 6) FROM c""",
)
def _(spark, d):
    return D.cluster_decomposition(_typed_orders(spark, d), "orders", "g", "kind", threshold=3.0)


@query("cluster_owners", f"{_SQL} SELECT kind AS cluster, round(p0, 6) AS share0, round(p1, 6) AS share1, round(short, 6) AS short, CASE WHEN short > 3 AND p1 > p0 THEN 1 ELSE 0 END AS owner FROM w")
def _(spark, d):
    return D.cluster_owners(_typed_orders(spark, d), "g", "kind", threshold=3.0)


@query("cluster_gap_bootstrap")
def _(spark, d):
    return D.bootstrap_cluster_decomposition(_typed_orders(spark, d), "orders", "g", "kind", "id", replicates=20, threshold=3.0)


def _weighted_days(spark, d):
    """Daily sequences, of which odd ids weigh twice, and a group by the id."""
    frame = fx.ev_daily(spark, d)
    long = frame.long.withColumn("weight", 1.0 + F.col("id") % 2)
    return SequenceFrame(long, frame.states, frame.labels, frame.missing_code), long.select("id", (F.col("id") % 3).cast("int").alias("group")).distinct()


#: CTEs over all pairs: windows of three days "w", groups "g" with weight, sum and mean, all "a", and distances to the groups' centres "c".
_DAYS = f"""WITH {fx.SQL["ev_daily"]}, q AS (SELECT a.id AS i, b.id AS j, a.pos, CASE WHEN a.s <> b.s THEN 1.0 ELSE 0.0 END AS m, a.id % 3 AS gi, b.id % 3 AS gj, 1e0 + a.id % 2 AS wi, 1e0 + b.id % 2 AS wj FROM p a JOIN p b ON a.pos = b.pos AND a.id <> b.id),
w AS (SELECT *, sum(m) OVER z AS d, count(*) OVER z AS n FROM q WINDOW z AS (PARTITION BY i, j ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) QUALIFY n = 3),
r AS (SELECT pos, id % 3 AS g, sum(1e0 + id % 2) AS w FROM p WHERE pos BETWEEN 2 AND 30 GROUP BY ALL),
a AS (SELECT pos, sum(wi * wj * d) / 2 AS s FROM w GROUP BY pos),
t AS (SELECT pos, sum(w) AS tw, count(*) AS k FROM r GROUP BY pos),
g AS (SELECT r.pos, r.g, r.w, coalesce(x.s, 0) / r.w / r.w AS v FROM r LEFT JOIN (SELECT pos, gi AS g, sum(wi * wj * d) / 2 AS s FROM w WHERE gi = gj GROUP BY ALL) x USING (pos, g)),
c AS (SELECT w.pos, w.i, any_value(gi) AS g, any_value(wi) AS w, sum(CASE WHEN gi = gj THEN wj * d ELSE 0 END) / any_value(g.w) - any_value(g.v) AS dc FROM w JOIN g ON g.pos = w.pos AND g.g = w.gi GROUP BY w.pos, w.i)"""


@query(
    "association_by_position",
    f"""{_DAYS}, z AS (SELECT pos, sum(z1) AS z1, sum(z2) AS z2, sum(z1 * z1 / w) AS zg FROM (SELECT pos, g, sum(w) AS w, sum(w * dc) AS z1, sum(w * dc * dc) AS z2 FROM c GROUP BY pos, g) GROUP BY pos),
h AS (SELECT pos, any_value(tw) AS tw, any_value(k) AS k, any_value(a.s) / any_value(tw) AS ss, sum(w * v) AS wi, sum((1 - w / tw) * v) AS un, sum((w - 1) * v) AS po, sum((w - 1) * CASE WHEN v > 0 THEN ln(v) ELSE 0 END) AS lo, sum(1 / (w - 1)) AS inv, count(*) FILTER (v <= 0) AS same FROM g JOIN t USING (pos) JOIN a USING (pos) GROUP BY pos)
SELECT CAST(pos AS INT) AS pos, tw AS weight, k AS groups, round(CASE WHEN wi > 1e-12 THEN (ss - wi) / (k - 1) / (wi / (tw - k)) END, 6) AS pseudo_f, round(CASE WHEN un > 1e-12 THEN (ss - wi) / un END, 6) AS pseudo_fbf, round(CASE WHEN ss <> 0 THEN (ss - wi) / ss END, 6) AS pseudo_r2,
  round(CASE WHEN same = 0 AND po > 0 THEN ((tw - k) * ln(po / (tw - k)) - lo) / (1 + (inv - 1 / (tw - k)) / (3 * (k - 1))) END, 6) AS bartlett, round(CASE WHEN z2 - zg > 1e-12 THEN (zg - z1 * z1 / tw) / (k - 1) / ((z2 - zg) / (tw - k)) END, 6) AS levene FROM h JOIN z USING (pos)""",
)
def _(spark, d):
    return P.association_by_position(*_weighted_days(spark, d), before=1, after=1)


@query("discrepancy_by_position", f"""{_DAYS} SELECT CAST(pos AS INT) AS pos, CAST(g AS INT) AS "group", w AS weight, round(v, 6) AS discrepancy FROM g UNION ALL SELECT CAST(pos AS INT), NULL, tw, round(s / tw / tw, 6) FROM a JOIN t USING (pos)""")
def _(spark, d):
    return P.discrepancy_by_position(*_weighted_days(spark, d), before=1, after=1)
