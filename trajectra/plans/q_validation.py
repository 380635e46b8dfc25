"""Queries on multi-factor association, typologies and memberships."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import clustering as C
from trajectra.operators import distances as D
from trajectra.operators import indicators as I
from trajectra.operators import multidomain as M
from trajectra.operators import validation as V
from trajectra.operators.mismatches import Mismatches
from trajectra.sources import fixtures as fx

from .q_groups import HAM, LEV
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


def _rows(spark, d):
    frame = fx.ev_daily(spark, d)
    rows = D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight")
    return frame, D.pairwise(frame, "HAM"), rows


def _sums(spark, d):
    """The same where sums of distances, or medoids, are enough."""
    frame = fx.ev_daily(spark, d)
    rows = D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight")
    return frame, Mismatches(frame), rows


@query("single_factor_by_projection", HAM + "SELECT t AS term, round(((st.ss - sw.ss) / (k - 1)) / (sw.ss / (W - k)), 6) AS pseudo_f, round(1 - sw.ss / st.ss, 6) AS pseudo_r2 FROM st, sw, tw, (SELECT unnest(['g', 'total']) AS t)")
def _(spark, d):
    _, pairs, rows = _sums(spark, d)
    return V.multifactor_association(pairs, rows.withColumn("g", F.col("id") % 3), ["g"])


@query("multifactor_association")
def _(spark, d):
    _, pairs, rows = _sums(spark, d)
    return V.multifactor_association(pairs, rows.withColumns({"g": F.col("id") % 3, "h": F.col("id") % 2}), ["g", "h"])


@query("individual_indicators", HAM + LEV + ", al AS (SELECT i, sum(wj * d) AS s FROM b GROUP BY i) SELECT dc.id, round(dc.dc, 6) AS marginality, round(al.s / tw.W - st.ss / tw.W - dc.dc, 6) AS gain FROM dc JOIN al ON al.i = dc.id, st, tw")
def _(spark, d):
    _, pairs, rows = _rows(spark, d)
    return V.individual_indicators(pairs, rows.withColumn("group", F.col("id") % 3))


@query("cluster_association")
def _(spark, d):
    _, pairs, rows = _sums(spark, d)
    labels = C.k_medoids(pairs, rows, 3).join(rows, "id").select("id", "weight", "cluster", (F.col("id") % 2).alias("parity"))
    return V.cluster_association(pairs, labels, "parity")


@query("merged_groups")
def _(spark, d):
    _, pairs, rows = _sums(spark, d)
    return V.merge_groups(pairs, rows.withColumn("group", F.col("id") % 5), 3)


@query("bootstrap_range")
def _(spark, d):
    _, pairs, rows = _sums(spark, d)
    return V.bootstrap_range(pairs, rows, [2, 3], replicates=4)


_STATES = (*fx.EVENT_TYPES, "missing")
_TIMES = ", ".join(f"CAST(least(floor(count(*) FILTER (s = {i}) / count(*) * 3), 2) AS INT) AS \"time_{x}\"" for i, x in enumerate(_STATES, 1))
_COUNTS = ", ".join(f"CAST(least(count(*) FILTER (s = {i}), 3) AS INT) AS \"spells_{x}\"" for i, x in enumerate(_STATES, 1))


@query(
    "sequence_properties",
    f"""WITH {fx.SQL['ev_daily']}, {fx.SPELLS_SQL}, t AS (SELECT id, {_TIMES}, CAST(arg_min(s, pos) AS INT) AS first, CAST(arg_max(s, pos) AS INT) AS last, count(*) AS n FROM p GROUP BY id), k AS (SELECT id, {_COUNTS}, count(*) AS m FROM sp GROUP BY id)
SELECT * EXCLUDE (n, m), 1::DOUBLE AS weight, CAST(least(floor((m - 1) / greatest(n - 1, 1) * 3), 2) AS INT) AS transitions FROM t JOIN k USING (id)""",
)
def _(spark, d):
    return V.properties(fx.ev_daily(spark, d))


@query("property_tree")
def _(spark, d):
    frame = fx.ev_daily(spark, d)
    return V.property_tree(frame, Mismatches(frame), min_size=10, max_depth=2)[1]


@query("soft_classification")
def _(spark, d):
    _, pairs, rows = _sums(spark, d)
    return V.soft_classification(C.fuzzy_medoids(pairs, rows, 3), 1)


@query("pseudoclass_regression")
def _(spark, d):
    frame, pairs, rows = _sums(spark, d)
    return V.pseudoclass_regression(C.fuzzy_medoids(pairs, rows, 3), I.complexity(frame).select("id", F.col("complexity").alias("y")))


@query("dirichlet_regression")
def _(spark, d):
    frame, pairs, rows = _sums(spark, d)
    soft = C.fuzzy_medoids(pairs, rows, 2).groupBy("id").agg(*[F.max(F.when(F.col("cluster") == c, F.col("u"))).alias(f"u{c}") for c in (1, 2)])
    return V.dirichlet_regression(soft.withColumn("x", F.col("id") % 2), ["u1", "u2"], ["x"])


@query("multidomain_clara")
def _(spark, d):
    domains = [fx.ev_all(spark, d), fx.bands_all(spark, d)]
    costs = [[[float(a != b) for b in range(f.n_states)] for a in range(f.n_states)] for f in domains]
    frame, table = M.additive_costs(domains, costs)
    return C.clara(frame, D.measure(frame, "OM", costs=table, indel=1.0), 3, samples=3, size=60)[0]


@query("pseudoclass_ols")
def _(spark, d):
    frame, pairs, rows = _sums(spark, d)
    people = I.complexity(frame).select("id", F.col("complexity").alias("y"), "entropy")
    return V.pseudoclass_ols(C.fuzzy_medoids(pairs, rows, 3), people, "y", ["entropy"])


@query("beta_regression")
def _(spark, d):
    _, pairs, rows = _sums(spark, d)
    first = C.fuzzy_medoids(pairs, rows, 2).where("cluster = 1").withColumn("x", F.col("id") % 2)
    return V.beta_regression(first, "u", ["x"])


@query("typology_effects")
def _(spark, d):
    _, pairs, rows = _sums(spark, d)
    return V.typology_effects(pairs, rows.withColumn("x", F.col("id") % 2), "x", 3, replicates=5)
