"""Queries on features, statistics, decompositions and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import indicators as I
from trajectra.operators import statistics as S
from trajectra.operators import uncertainty as U
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


@query("weighted_moments", "WITH v AS (SELECT l_returnflag, l_discount AS v, l_quantity AS w FROM lineitem), s AS (SELECT l_returnflag, count(*) AS n, sum(w) AS tot, sum(w * v) AS s, sum(w * v * v) AS q FROM v GROUP BY ALL) SELECT l_returnflag, n, round(tot, 6) AS weight, round(s / tot, 6) AS mean, round((q - s * s / tot) / (tot - 1), 6) AS variance, round((q - s * s / tot) / tot, 6) AS variance_ml FROM s")
def _(spark, d):
    return S.weighted_moments(table(spark, d, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"])


@query("five_numbers", " UNION ALL ".join(f"SELECT o_orderpriority, {q}::DOUBLE AS p, round(quantile_cont(o_totalprice, {q}), 6) AS value FROM orders GROUP BY o_orderpriority" for q in (0.0, 0.25, 0.5, 0.75, 1.0)))
def _(spark, d):
    return S.weighted_five_numbers(table(spark, d, "orders"), "o_totalprice", None, ["o_orderpriority"])


@query("duration_features", f"WITH {fx.SQL['ord_status']} SELECT id, CAST(count(*) FILTER (s = 1) AS INT) AS \"dur_F\", CAST(count(*) FILTER (s = 2) AS INT) AS \"dur_O\", CAST(count(*) FILTER (s = 3) AS INT) AS \"dur_P\" FROM p GROUP BY id")
def _(spark, d):
    return S.duration_features(fx.ord_status(spark, d))


_TIMING = ", ".join(f"CAST(max(CASE WHEN s = {i} AND {e} >= {b} AND {e} < {b + 10} THEN 1 ELSE 0 END) AS INT) AS \"{w}_{n}_{b}\"" for w, e in (("start", "b"), ("end", "(b + d - 1)")) for i, n in enumerate("FOP", 1) for b in (1, 11, 21, 31))


@query("timing_features", f"WITH {fx.SQL['ord_status']}, {fx.SPELLS_SQL} SELECT id, {_TIMING} FROM sp GROUP BY id")
def _(spark, d):
    return S.timing_features(fx.ord_status(spark, d), 10, 40)


@query("sequencing_features")
def _(spark, d):
    return S.sequencing_features(fx.ord_status(spark, d), 300)


def _people(spark, d):
    frame = fx.ev_all(spark, d)
    values = I.complexity(frame).select("id", "complexity", F.col("transitions").cast("double").alias("transitions"), "entropy")
    return values.withColumn("g", (F.col("id") % 2).cast("int"))


@query("regression", "WITH x AS (SELECT l_quantity AS q, l_discount AS d, l_extendedprice AS y FROM lineitem), m AS (SELECT regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM x) SELECT 'constant' AS term, round(a, 4) AS coefficient FROM m UNION ALL SELECT 'l_quantity', round(b, 4) FROM m")
def _(spark, d):
    return S.regression(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").select("term", F.round("coefficient", 4).alias("coefficient"))


@query("gap_decomposition", "WITH x AS (SELECT l_quantity AS q, l_extendedprice AS y, l_linenumber % 2 AS g FROM lineitem), m AS (SELECT g, avg(q) AS q, avg(y) AS y, regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM x GROUP BY g), p AS (SELECT regr_slope(y, q) AS b, regr_intercept(y, q) AS a FROM x), z AS (SELECT m0.y - m1.y AS gap, (m0.q - m1.q) * p.b AS ex, m0.q * (m0.b - p.b) + m1.q * (p.b - m1.b) AS ret, m0.a - m1.a AS con FROM m m0, m m1, p WHERE m0.g = 0 AND m1.g = 1) SELECT unnest(['gap', 'explained', 'returns', 'constant', 'explained_l_quantity', 'returns_l_quantity']) AS component, round(unnest([gap, ex, ret, con, ex, ret]), 3) AS value FROM z")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("g", F.col("l_linenumber") % 2)
    return S.oaxaca_blinder(rows, ["l_quantity"], "l_extendedprice", "g").select("component", (F.round("value", 3) + 0.0).alias("value"))


@query("gap_bootstrap")
def _(spark, d):
    return S.bootstrap_oaxaca(_people(spark, d), ["transitions", "entropy"], "complexity", "g", "id", replicates=20)


@query("cluster_composition", f"WITH {fx.SQL['ev_all']}, l AS (SELECT DISTINCT id, CAST(id % 3 AS INT) AS cluster, CAST(id % 2 AS INT) AS g FROM p), c AS (SELECT cluster, g, count(*) AS n FROM l GROUP BY ALL) SELECT cluster, g AS \"group\", n, round(n / sum(n) OVER (PARTITION BY g), 6) AS share FROM c")
def _(spark, d):
    ids = fx.ev_all(spark, d).long.select("id").distinct()
    return S.cluster_composition(ids.select("id", (F.col("id") % 3).cast("int").alias("cluster")), ids.select("id", (F.col("id") % 2).cast("int").alias("group")))


@query("correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def _(spark, d):
    return S.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("relevant_features")
def _(spark, d):
    return S.relevant_features(_people(spark, d), ["transitions", "entropy"], "complexity", rounds=8, key="id")


def _replicates(spark, d):
    return U.replicates(fx.ev_daily(spark, d), 5, U.error_distribution(1.0, 4))


@query("timing_replicates")
def _(spark, d):
    return _replicates(spark, d)


@query("replicate_spread")
def _(spark, d):
    return U.distance_spread(_replicates(spark, d))


@query("replicate_correlation")
def _(spark, d):
    return U.replicate_correlation(_replicates(spark, d))


@query("replicate_zero", f"WITH {fx.SQL['ev_daily']} SELECT id, array_to_string(list(s ORDER BY pos), '-') AS seq FROM p GROUP BY id")
def _(spark, d):
    return _replicates(spark, d).where("rep = 0").select("id", F.array_join(F.col("seq").cast("array<string>"), "-").alias("seq"))


@query("replicate_agreement")
def _(spark, d):
    return U.replicate_agreement(_replicates(spark, d), 3)


def _periods(spark, d):
    """(rep, id, seq, weight): three periods of ten days as replicates of a panel."""
    rows = fx.ev_daily(spark, d).long.where("pos <= 30").withColumn("rep", F.expr("(pos - 1) DIV 10").cast("int"))
    met = rows.groupBy("rep", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("x"), F.first("weight").alias("weight"))
    return met.select("rep", "id", F.col("x.code").alias("seq"), "weight")


_PERIODS = f"WITH {fx.SQL['ev_daily']}, q AS (SELECT (pos - 1) // 10 AS rep, id, list(s ORDER BY pos) AS x FROM p WHERE pos <= 30 GROUP BY ALL), m AS (SELECT a.rep, a.id AS i, b.id AS j, CAST(list_sum(list_transform(range(1, 11), lambda t: CASE WHEN a.x[t] = b.x[t] THEN 0 ELSE 1 END)) AS DOUBLE) AS d FROM q a JOIN q b ON a.rep = b.rep AND a.id < b.id)"


@query("union_distances", f"{_PERIODS} SELECT CAST(rep AS INT) AS rep, i, j, d FROM m")
def _(spark, d):
    """Distances within each period; sequences that several periods have are compared once."""
    return U.replicate_distances(_periods(spark, d), fx.ev_daily(spark, d), "HAM")


@query("union_spread", f"{_PERIODS} SELECT i, j, max(d) FILTER (rep = 0) AS observed, round(avg(d) FILTER (rep > 0), 6) AS mean, round(stddev_samp(d) FILTER (rep > 0), 6) AS sd, round(avg(d) FILTER (rep > 0) - max(d) FILTER (rep = 0), 6) AS bias, round(avg((d - o) * (d - o)) FILTER (rep > 0), 6) AS mse FROM m JOIN (SELECT i, j, d AS o FROM m WHERE rep = 0) USING (i, j) GROUP BY i, j")
def _(spark, d):
    return U.spread_of(U.replicate_distances(_periods(spark, d), fx.ev_daily(spark, d), "HAM"))


@query("timing_replicates_relative")
def _(spark, d):
    return U.relative_replicates(fx.ev_daily(spark, d), 5, U.error_distribution(1.0, 4))
