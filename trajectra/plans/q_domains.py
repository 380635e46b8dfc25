"""Queries on several domains and on relational sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import clustering as C
from trajectra.operators import distances as D
from trajectra.operators import multidomain as M
from trajectra.operators.mismatches import Mismatches
from trajectra.operators import relational as L
from trajectra.operators import structural as P
from trajectra.sources import fixtures as fx
from trajectra.sources.tables import table

from .rounding import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HAM6, HAM4 = ([[float(a != b) for b in range(n)] for a in range(n)] for n in (6, 4))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _two(spark, d):
    return [fx.ev_all(spark, d), fx.bands_all(spark, d)]


def _daily(spark, d):
    return [fx.ev_daily(spark, d), fx.bands_daily(spark, d)]


TWO = f"WITH {fx.SQL['ev_all']}, {fx.SQL['bands_all']}"
PANELS = f"WITH {fx.SQL['ev_daily']}, {fx.SQL['bands_daily']}"
STATE = "['click', 'error', 'purchase', 'signup', 'view'][p.s] || '+' || ['high', 'low', 'mid'][p2.s]"


@query("combined_states", TWO + f", c AS (SELECT {STATE} AS state FROM p JOIN p2 USING (id, pos)) SELECT state, CAST(count(*) AS DOUBLE) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY state")
def _(spark, d):
    return M.combined_states(_two(spark, d))


PAIRS = PANELS + ", a AS (SELECT p.id, list(p.s ORDER BY pos) AS x, list(p2.s ORDER BY pos) AS y FROM p JOIN p2 USING (id, pos) GROUP BY p.id), u AS (SELECT min(id) AS uid, x, y FROM a GROUP BY x, y), h AS (SELECT a.uid AS i, b.uid AS j, list_sum(list_transform(range(1, 32), lambda t: CASE WHEN a.x[t] = b.x[t] THEN 0.0 ELSE 1.0 END)) AS dx, list_sum(list_transform(range(1, 32), lambda t: CASE WHEN a.y[t] = b.y[t] THEN 0.0 ELSE 1.0 END)) AS dy FROM u a JOIN u b ON a.uid < b.uid)"


@query("distances_summed", PAIRS + " SELECT i, j, round(CAST(dx + 2 * dy AS DOUBLE), 6) AS d FROM h")
def _(spark, d):
    return M.summed_distances(_daily(spark, d), [{"method": "HAM"}, {"method": "HAM"}], [1.0, 2.0])


@query("distances_additive_costs", PAIRS + " SELECT i, j, round(CAST(dx + 2 * dy AS DOUBLE), 6) AS d FROM h")
def _(spark, d):
    return M.additive_cost_distances(_daily(spark, d), [HAM6, HAM4], "HAM", weights=[1.0, 2.0])[1]


@query("domain_contributions", PAIRS + " SELECT CAST(k AS INT) AS domain, round(CAST(CASE k WHEN 0 THEN sum(dx) ELSE sum(dy) END / (sum(dx) + sum(dy)) AS DOUBLE), 6) AS share FROM h, (SELECT unnest([0, 1]) AS k) GROUP BY k")
def _(spark, d):
    frames = _daily(spark, d)
    return M.domain_contributions([D.pairwise(f, "HAM") for f in frames])


@query("domain_association", TWO + ", c AS (SELECT p.s AS x, p2.s AS y, count(*) AS n FROM p JOIN p2 USING (id, pos) GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS c, sum(n) OVER () AS t FROM c), q AS (SELECT sum(2 * n * ln(n / (r * c / t))) AS lrt, sum(n * n / (r * c / t)) AS q, any_value(t) AS t FROM m) SELECT CAST(t AS DOUBLE) AS n, round(lrt, 6) AS lrt, CAST(8 AS INT) AS df, round(sqrt((q - t) / t / 2), 6) AS cramer_v FROM q")
def _(spark, d):
    return M.association(*_two(spark, d)).drop("p_value")


@query("combined_typology", f"WITH {fx.SQL['ev_all']} SELECT DISTINCT id, CAST(id % 2 AS VARCHAR) || '-' || CAST(id % 3 AS VARCHAR) AS type FROM p")
def _(spark, d):
    ids = fx.ev_all(spark, d).long.select("id").distinct()
    return M.combined_typology([ids.select("id", (F.col("id") % 2).alias("cluster")), ids.select("id", (F.col("id") % 3).alias("cluster"))])


@query("merged_typology")
def _(spark, d):
    frame = fx.ev_daily(spark, d)
    types = frame.long.select("id", F.concat(F.lit("t"), F.least(F.col("id") % 11, F.lit(5)).cast("string")).alias("type")).distinct()
    return M.merge_sparse_types(types, D.pairwise(frame, "HAM"), 20)


@query("linked_polyads")
def _(spark, d):
    frame = fx.ev_daily(spark, d)
    return M.linked_polyads([frame, frame.__class__(frame.long.withColumn("code", F.pmod(F.col("code") + F.col("pos") % 2, F.lit(frame.n_states)) + 1), frame.states, frame.labels, frame.missing_code)], draws=20)


def _relational(spark, d):
    """Most frequent status by region, priority and year."""
    orders, customers, nations = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy(F.col("n_regionkey").alias("level_1"), F.col("o_orderpriority").alias("level_2"), F.year("o_orderdate").alias("time"), "o_orderstatus").agg(F.count("*").alias("n"))
    top = counts.groupBy("level_1", "level_2", "time").agg(F.max(F.struct("n", "o_orderstatus")).alias("x")).select("level_1", "level_2", "time", F.col("x.o_orderstatus").alias("state"))
    return L.make(top, "level_1", "level_2", "time", "state", list(fx.STATUSES)), top


REL = "WITH c AS (SELECT n_regionkey AS l1, o_orderpriority AS l2, year(o_orderdate) AS t, o_orderstatus AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), top AS (SELECT l1, l2, t, arg_max(s, (n, s)) AS s FROM c GROUP BY ALL), pr AS (SELECT a.l1 AS a1, a.l2 AS a2, b.l1 AS b1, b.l2 AS b2, CAST(count(*) FILTER (a.s <> b.s) AS DOUBLE) AS d FROM top a JOIN top b ON a.t = b.t AND (a.l1, a.l2) < (b.l1, b.l2) GROUP BY ALL)"


def _relational_pairs(spark, d):
    (frame, units), _ = _relational(spark, d)
    return D.expand(frame, D.pairwise(frame, "HAM")), units


@query("relational_check", REL + " SELECT count(*) AS n_pairs, CAST(sum(n - k) AS BIGINT) AS n_repeated, bool_and(k = (SELECT count(DISTINCT t) FROM top)) AS balanced FROM (SELECT l1, l2, count(*) AS n, count(DISTINCT t) AS k FROM top GROUP BY ALL)")
def _(spark, d):
    return L.check_panel(_relational(spark, d)[1], "level_1", "level_2", "time")


@query("distance_by_structure", REL + " SELECT CASE WHEN a1 = b1 THEN 'same_level_1' WHEN a2 = b2 THEN 'same_level_2' ELSE 'neither' END AS relation, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM pr GROUP BY ALL")
def _(spark, d):
    return L.distance_by_structure(*_relational_pairs(spark, d))


@query("discrepancy_by_level", REL + ", k AS (SELECT count(*) AS n, count(DISTINCT l1) AS k1, count(DISTINCT l2) AS k2 FROM (SELECT DISTINCT l1, l2 FROM top)), s AS (SELECT sum(d) / any_value(n) AS t FROM pr, k), w1 AS (SELECT sum(s / m) AS w FROM (SELECT a1 AS g, sum(d) AS s FROM pr WHERE a1 = b1 GROUP BY a1) JOIN (SELECT l1 AS g, count(DISTINCT l2) AS m FROM top GROUP BY l1) USING (g)), w2 AS (SELECT sum(s / m) AS w FROM (SELECT a2 AS g, sum(d) AS s FROM pr WHERE a2 = b2 GROUP BY a2) JOIN (SELECT l2 AS g, count(DISTINCT l1) AS m FROM top GROUP BY l2) USING (g)) SELECT 'level_1' AS level, round(1 - w / t, 6) AS pseudo_r2, round(((t - w) / (k1 - 1)) / (w / (n - k1)), 6) AS pseudo_f FROM s, w1, k UNION ALL SELECT 'level_2', round(1 - w / t, 6), round(((t - w) / (k2 - 1)) / (w / (n - k2)), 6) FROM s, w2, k")
def _(spark, d):
    return L.discrepancy_by_level(*_relational_pairs(spark, d))


@query("unit_profiles", REL + ", b AS (SELECT a1 AS u, b1 AS v, d FROM pr UNION ALL SELECT b1, a1, d FROM pr) SELECT u AS unit, (SELECT count(DISTINCT l2) FROM top WHERE l1 = u) AS n_pairs, round(avg(d) FILTER (u = v), 6) AS within, round(avg(d) FILTER (u <> v), 6) AS to_others FROM b GROUP BY u")
def _(spark, d):
    return L.unit_profiles(*_relational_pairs(spark, d))


@query("unit_distances", REL + " SELECT least(a1, b1) AS u, greatest(a1, b1) AS v, round(avg(d), 6) AS d FROM pr WHERE a1 <> b1 GROUP BY ALL")
def _(spark, d):
    return L.unit_distances(*_relational_pairs(spark, d))


@query("crossed_discrepancy")
def _(spark, d):
    return L.crossed_discrepancy(*_relational_pairs(spark, d))


@query("relational_outliers")
def _(spark, d):
    return L.outliers(*_relational_pairs(spark, d), threshold=0.5)


@query("sampled_distances")
def _(spark, d):
    (frame, units), _ = _relational(spark, d)
    return L.sampled_distances(frame, units)


@query("state_space", TWO + f", c AS (SELECT {STATE} AS state FROM p JOIN p2 USING (id, pos)), n AS (SELECT state, count(*) AS n FROM c GROUP BY state) SELECT CAST(15 AS BIGINT) AS n_possible, count(*) AS n_seen, round(count(*) / 15, 6) AS share_seen, round(max(n) / sum(n), 6) AS largest, count(*) FILTER (n <= 1) AS n_once FROM n")
def _(spark, d):
    return M.state_space(_two(spark, d))


@query("leave_one_domain_out")
def _(spark, d):
    frames = _daily(spark, d)
    rows = D.unique_sequences(frames[0]).select(F.col("uid").alias("id"), "weight")
    return M.leave_one_out([Mismatches(f) for f in frames], rows, 2)


@query("sample_coverage")
def _(spark, d):
    return M.sample_coverage(fx.ord_status(spark, d), 3, 100)


@query("relational_compressed", REL + ", q AS (SELECT l1, l2, string_agg(CAST(list_position(['F', 'O', 'P'], s) AS VARCHAR), '-' ORDER BY t) AS pattern FROM top GROUP BY l1, l2) SELECT pattern, count(*) AS n, CAST(count(*) AS DOUBLE) AS weight FROM q GROUP BY pattern")
def _(spark, d):
    return L.compressed(_relational(spark, d)[0][0]).drop("first_id")


@query("level_test")
def _(spark, d):
    return L.level_test(*_relational_pairs(spark, d))


@query("clustered_units")
def _(spark, d):
    return L.cluster_units(*_relational_pairs(spark, d), k=2)


#: Each distinct pair of daily sequences against those of users 1 and 2: mismatches of events, and twice those of bands.
_TO_TWO = f"""WITH {fx.SQL["ev_daily"]}, {fx.SQL["bands_daily"]}, b AS (SELECT id, pos, p.s AS s, p2.s AS t FROM p JOIN p2 USING (id, pos)),
u AS (SELECT id, list(s ORDER BY pos) AS q, list(t ORDER BY pos) AS r FROM b GROUP BY id), e AS (SELECT min(id) AS i, q, r FROM u GROUP BY q, r)
SELECT e.i, CAST(f.id - 1 AS INT) AS ref, CAST(list_sum(list_transform(range(1, {fx.DAYS + 1}), lambda k: CASE WHEN e.q[k] = f.q[k] THEN 0 ELSE 1 END + CASE WHEN e.r[k] = f.r[k] THEN 0 ELSE 2 END)) AS DOUBLE) AS d FROM e, u f WHERE f.id IN (1, 2)"""


@query("summed_references", _TO_TWO)
def _(spark, d):
    frame, how = M.summed(_daily(spark, d), [{"method": "HAM"}, {"method": "HAM"}], [1.0, 2.0])
    two = [list(r.seq) for r in frame.arrays.where("id IN (1, 2)").orderBy("id").collect()]
    return D.to_references(frame, two, how)


@query("multidomain_clara_sums")
def _(spark, d):
    frame, how = M.summed([fx.ev_all(spark, d), fx.bands_all(spark, d)], [{"method": "OM", "indel": 1.0}, {"method": "LCS"}], [1.0, 2.0], "mean")
    return C.clara(frame, how, 3, samples=3, size=60)[0]


@query("structural_counts", """WITH u AS (SELECT DISTINCT o_custkey % 40 AS a, o_custkey % 25 AS b, o_custkey AS id FROM orders), r AS (SELECT CASE WHEN x.a = y.a AND x.b = y.b THEN 'same_pair' WHEN x.a = y.a THEN 'same_level_1' WHEN x.b = y.b THEN 'same_level_2' ELSE 'neither' END AS relation FROM u x JOIN u y ON x.id < y.id)
SELECT k AS relation, (SELECT count(*) FROM r WHERE relation = k) AS n FROM (VALUES ('same_pair'), ('same_level_1'), ('same_level_2'), ('neither')) v(k)""")
def _(spark, d):
    return P.pair_counts(_customer_units(spark, d))


def _customer_units(spark, d):
    """Customers with orders, by two remainders of their keys."""
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return keys.select("id", (F.col("id") % 40).alias("level_1"), (F.col("id") % 25).alias("level_2"))


@query("structural_sample")
def _(spark, d):
    return P.sampled_by_relation(fx.ord_status(spark, d), _customer_units(spark, d), {"same_level_1": 2_000, "same_level_2": 2_000, "neither": 4_000})
