"""Queries on pair tables: discrepancy, representatives, clustering and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import clustering as C
from trajectra.operators import discrepancy as A
from trajectra.operators import distances as D
from trajectra.operators import mismatches as M
from trajectra.operators import permutations as T
from trajectra.operators import representatives as R
from trajectra.operators import schedules as H
from trajectra.operators import validation as V
from trajectra.operators.sequences import SequenceFrame
from trajectra.sources import fixtures as fx

from .q_distances import PANEL
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


def _ham(spark, d):
    """Hamming pairs of ev_daily and its rows in three groups."""
    frame = fx.ev_daily(spark, d)
    rows = D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight", (F.col("uid") % 3).cast("int").alias("group"))
    return D.pairwise(frame, "HAM"), rows


def _sums(spark, d):
    """The same where sums of the distances are enough."""
    frame = fx.ev_daily(spark, d)
    rows = D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight", (F.col("uid") % 3).cast("int").alias("group"))
    return M.Mismatches(frame), rows


#: CTEs "h" (i, j, d), "r" (id, w, g), "b" (both directions with weights and groups), and sums of squares.
HAM = PANEL + """, h AS (SELECT i, j, CAST(list_sum(list_transform(range(1, 32), lambda t: CASE WHEN x[t] = y[t] THEN 0 ELSE 1 END)) AS DOUBLE) AS d FROM pr),
 r AS (SELECT uid AS id, CAST((SELECT count(*) FROM arr WHERE arr.q = u.q) AS DOUBLE) AS w, CAST(uid % 3 AS INT) AS g FROM u),
 hw AS (SELECT h.*, a.w AS wi, a.g AS gi, b.w AS wj, b.g AS gj FROM h JOIN r a ON a.id = i JOIN r b ON b.id = j),
 b AS (SELECT i, j, d, wj, gi, gj FROM hw UNION ALL SELECT j, i, d, wi, gj, gi FROM hw),
 tw AS (SELECT sum(w) AS W, count(*) AS n, count(DISTINCT g) AS k FROM r), gw AS (SELECT g, sum(w) AS W, count(*) AS n FROM r GROUP BY g),
 st AS (SELECT sum(wi * wj * d) / any_value(W) AS ss FROM hw, tw), sg AS (SELECT gi AS g, sum(wi * wj * d) AS s FROM hw WHERE gi = gj GROUP BY gi),
 sw AS (SELECT sum(s / W) AS ss FROM sg JOIN gw USING (g))
"""


@query("overall_discrepancy", HAM + "SELECT n, W AS weight, round(ss, 6) AS ss, round(ss / W, 6) AS discrepancy FROM st, tw")
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return A.overall_discrepancy(pairs, rows)


@query("group_discrepancy", HAM + 'SELECT g AS "group", n, W AS weight, round(s / W, 6) AS ss, round(s / W / W, 6) AS discrepancy FROM sg JOIN gw USING (g)')
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return A.group_discrepancy(pairs, rows)


LEV = ", dcs AS (SELECT i, gi, sum(wj * d) AS s FROM b WHERE gi = gj GROUP BY i, gi), dc AS (SELECT r.id, r.g, r.w, coalesce(dcs.s, 0) / gw.W - sg.s / gw.W / gw.W AS dc FROM r LEFT JOIN dcs ON dcs.i = r.id JOIN gw ON gw.g = r.g JOIN sg ON sg.g = r.g), lv AS (SELECT g, sum(w) AS w, sum(w * dc) AS s, sum(w * dc * dc) AS q FROM dc GROUP BY g), lt AS (SELECT ((sum(s * s / w) - sum(s) ** 2 / sum(w)) / (count(*) - 1)) / ((sum(q) - sum(s * s / w)) / (sum(w) - count(*))) AS levene FROM lv)"


@query("association", HAM + LEV + " SELECT n, k AS groups, round(st.ss, 6) AS ss_total, round(sw.ss, 6) AS ss_within, round(st.ss - sw.ss, 6) AS ss_explained, round(((st.ss - sw.ss) / (k - 1)) / (sw.ss / (W - k)), 6) AS pseudo_f, round(1 - sw.ss / st.ss, 6) AS pseudo_r2, round(levene, 6) AS levene FROM st, sw, tw, lt")
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return A.association(pairs, rows)


@query("distances_to_center", HAM + LEV + ' SELECT id, g AS "group", w AS weight, round(dc, 6) AS dc FROM dc')
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return A.distances_to_center(pairs, rows)


@query("medoids", HAM + ', t AS (SELECT r.id, r.g, round(coalesce(sum(b.wj * b.d), 0), 6) AS total FROM r LEFT JOIN b ON b.i = r.id AND b.gi = b.gj GROUP BY r.id, r.g) SELECT g AS "group", arg_min(id, (total, id)) AS medoid, min(total) AS total FROM t GROUP BY g')
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return R.medoids(pairs, rows)


@query("neighbourhood_density", HAM + ", m AS (SELECT max(d) * 0.7 AS r FROM h) SELECT r.id, round(any_value(r.w) + coalesce(sum(b.wj) FILTER (b.d < m.r), 0), 6) AS density FROM r CROSS JOIN m LEFT JOIN b ON b.i = r.id GROUP BY r.id")
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return R.neighbourhood_density(pairs, rows, 0.7)


@query("silhouettes", HAM + ', s AS (SELECT i, gi, gj, sum(wj * d) AS s FROM b GROUP BY ALL), c AS (SELECT r.id, r.g, r.w, any_value(gw.W) AS tot, coalesce(max(s.s) FILTER (s.gj = r.g), 0) AS s, min(s.s / o.W) FILTER (s.gj <> r.g) AS b FROM r JOIN gw ON gw.g = r.g LEFT JOIN s ON s.i = r.id LEFT JOIN gw o ON o.g = s.gj GROUP BY r.id, r.g, r.w) SELECT id, g AS cluster, w AS weight, round(s / (tot - 1), 6) AS a, round(b, 6) AS b, round((b - s / (tot - 1)) / greatest(b, s / (tot - 1)), 6) AS asw, round((b - s / tot) / greatest(b, s / tot), 6) AS asww FROM c')
def _(spark, d):
    pairs, rows = _ham(spark, d)
    return C.silhouettes(pairs, rows.select("id", F.col("group").alias("cluster"), "weight"))


@query("group_difference", HAM.replace("uid % 3", "uid % 2") + ", x AS (SELECT n * (ln(st.ss / n) - ln(sw.ss / n)) AS lrt, n FROM st, sw, tw) SELECT n, round(lrt, 6) AS lrt, round(lrt - ln(n), 6) AS bic, round(exp((lrt - ln(n)) / 2), 6) AS bayes_factor FROM x")
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return A.group_difference(pairs, rows.withColumn("group", (F.col("id") % 2).cast("int"))).drop("p_value")


@query("compare_by_position", f"WITH {fx.SQL['ev_daily']}, q AS (SELECT a.id AS i, b.id AS j, a.pos, CASE WHEN a.s <> b.s THEN 1.0 ELSE 0.0 END AS m, a.id % 3 AS gi, b.id % 3 AS gj FROM p a JOIN p b ON a.pos = b.pos AND a.id < b.id), w AS (SELECT *, sum(m) OVER (PARTITION BY i, j ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS d FROM q), t AS (SELECT pos, sum(d) AS s FROM w GROUP BY pos), g AS (SELECT pos, gi AS g, sum(d) AS s FROM w WHERE gi = gj GROUP BY ALL), n AS (SELECT pos, id % 3 AS g, count(*) AS n FROM p GROUP BY ALL), x AS (SELECT pos, sum(coalesce(s, 0) / n) AS wi, sum(n) AS n, count(*) AS k FROM n LEFT JOIN g USING (pos, g) GROUP BY pos) SELECT CAST(pos AS INT) AS pos, round(((s / n - wi) / (k - 1)) / (wi / (n - k)), 6) AS pseudo_f, round(1 - wi / (s / n), 6) AS pseudo_r2 FROM x JOIN t USING (pos)")
def _(spark, d):
    frame = fx.ev_daily(spark, d)
    return A.compare_by_position(frame, frame.long.select("id", (F.col("id") % 3).cast("int").alias("group")).distinct())


@query("permutation_test")
def _(spark, d):
    pairs, rows = _ham(spark, d)
    return A.permutation_test(pairs, rows, 49)


@query("representatives")
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return R.representatives(pairs, rows.select("id", "weight"), share=0.7)


@query("frequency_groups")
def _(spark, d):
    pairs, rows = _ham(spark, d)
    return R.frequency_groups(pairs, rows.select("id", "weight"), 10, R.classical_scaling(pairs, rows.select("id", "weight")))


@query("distance_tree")
def _(spark, d):
    pairs, rows = _sums(spark, d)
    rows = rows.withColumn("parity", F.col("id") % 2).withColumn("fifth", F.col("id") % 5)
    return A.distance_tree(pairs, rows, ["parity", "fifth"], min_size=10, max_depth=2, min_r2=0.0)[1]


@query("distance_tree_tested")
def _(spark, d):
    pairs, rows = _sums(spark, d)
    rows = rows.withColumn("parity", F.col("id") % 2).withColumn("fifth", F.col("id") % 5)
    return A.distance_tree(pairs, rows, ["parity", "fifth"], min_size=10, max_depth=2, min_r2=0.0, replicates=49, max_p=0.9)[1]


def _property_tree(spark, d):
    frame = fx.ord_status(spark, d)
    unique = SequenceFrame(frame.long.join(D.unique_sequences(frame).select(F.col("uid").alias("id")), "id", "left_semi"), frame.states, frame.labels, frame.missing_code)
    return V.property_tree(unique, D.pairwise(unique, "LCS"), min_size=10, max_depth=3)


@query("property_tree_cuts")
def _(spark, d):
    """Each distinct sequence's cluster at two to four clusters."""
    root, leaves = _property_tree(spark, d)
    return H.cut(leaves, root, range(2, min(4, len(root.leaves())) + 1))


@query("property_tree_schedule")
def _(spark, d):
    return H.schedule_table(spark, _property_tree(spark, d)[0])


#: The F and the share explained of each of two sets of users; the draws have no SQL and are left out.
@query(
    "set_associations",
    f"""WITH {fx.SQL['ev_daily']}, a AS (SELECT id, list(s ORDER BY pos) AS x FROM p GROUP BY id), q AS (SELECT a.id % 2 AS s, a.id % 3 AS gi, b.id % 3 AS gj, list_sum(list_transform(range(1, 32), lambda t: CASE WHEN a.x[t] = b.x[t] THEN 0.0 ELSE 1.0 END)) AS d FROM a JOIN a b ON a.id < b.id AND a.id % 2 = b.id % 2),
n AS (SELECT id % 2 AS s, id % 3 AS g, count(*) AS n FROM a GROUP BY ALL), w AS (SELECT s, gi AS g, sum(d) AS d FROM q WHERE gi = gj GROUP BY ALL), z AS (SELECT n.s, sum(coalesce(w.d, 0) / n) AS wi, sum(n) AS n, count(*) AS k FROM n LEFT JOIN w ON w.s = n.s AND w.g = n.g GROUP BY n.s), t AS (SELECT s, sum(d) AS d FROM q GROUP BY s)
SELECT CAST(s AS BIGINT) AS set, CAST(k AS INT) AS groups, round((d / n - wi) / (k - 1) / (wi / (n - k)), 6) AS pseudo_f, round(1 - wi / (d / n), 6) AS pseudo_r2 FROM z JOIN t USING (s)""",
)
def _(spark, d):
    pairs, rows = _sums(spark, d)
    return T.set_tests(pairs, rows.select("id", "weight", (F.col("id") % 2).alias("set"), (F.col("id") % 3).alias("group")), 19).drop("p_value")


def _weighted(spark, d):
    """Hamming pairs of the distinct daily sequences and their weights."""
    frame = fx.ev_daily(spark, d)
    return D.pairwise(frame, "HAM"), D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight")


def _panel(spark, d):
    """The same without a pair table."""
    frame = fx.ev_daily(spark, d)
    return M.Mismatches(frame), D.unique_sequences(frame).select(F.col("uid").alias("id"), "weight")


@query("linkage")
def _(spark, d):
    return C.hierarchical(*_panel(spark, d), method="average")


@query("linkage_ward")
def _(spark, d):
    return C.hierarchical(*_panel(spark, d), method="ward")


@query("linkage_divisive")
def _(spark, d):
    return C.cluster_labels(*_panel(spark, d), ks=[2, 3], method="diana")


@query("cluster_labels")
def _(spark, d):
    return C.cluster_labels(*_panel(spark, d), ks=[2, 3, 4])


@query("cluster_range")
def _(spark, d):
    return C.cluster_range(*_panel(spark, d), ks=[2, 3, 4, 5])


@query("k_medoids")
def _(spark, d):
    return C.k_medoids(*_panel(spark, d), k=4)


@query("fuzzy_medoids")
def _(spark, d):
    return C.fuzzy_medoids(*_panel(spark, d), k=3)


@query("fuzzy_analysis")
def _(spark, d):
    return C.fuzzy_analysis(*_panel(spark, d), k=3)


@query("crispness")
def _(spark, d):
    return C.crispness(C.fuzzy_medoids(*_panel(spark, d), k=3))


@query("most_typical")
def _(spark, d):
    return C.most_typical(C.fuzzy_medoids(*_panel(spark, d), k=3))


@query("clara")
def _(spark, d):
    frame = fx.ord_seq(spark, d)
    return C.clara(frame, D.measure(frame, "OM", indel=1.0), 4, samples=4, size=120)[0]


#: The assignments and objectives of PAM samples are checked by the tests against loops.
@query("clara_objectives")
def _(spark, d):
    frame = fx.ord_seq(spark, d)
    return C.clara(frame, D.measure(frame, "OM", indel=1.0), 3, samples=3, size=100, objective="pbm", stability=True)[1]


@query("clara_fuzzy")
def _(spark, d):
    frame = fx.ord_seq(spark, d)
    return C.clara(frame, D.measure(frame, "OM", indel=1.0), 3, samples=2, size=80, objective="xb", method="FCMdd")[1]


@query("clara_representativeness")
def _(spark, d):
    """Distances over the longer length, which are 2 at most."""
    frame = fx.ord_seq(spark, d)
    return C.clara_representativeness(frame, D.measure(frame, "OM", indel=1.0, norm="maxlength"), 3, 2.0, samples=3, size=100)[0]


@query("cluster_methods")
def _(spark, d):
    return C.compare_methods(*_panel(spark, d), methods=["average", "PAM"], ks=[2, 3])


@query("cluster_methods_normalized")
def _(spark, d):
    return C.normalized_quality(C.cluster_range(*_panel(spark, d), ks=[2, 3, 4]), "range")


@query("cluster_distribution", HAM + "SELECT g AS cluster, n, CAST(gw.W AS DOUBLE) AS weight, round(gw.W / tw.W, 6) AS share FROM gw, tw".replace("SELECT g AS cluster, n,", "SELECT g AS cluster, gw.n AS n,"))
def _(spark, d):
    _, rows = _ham(spark, d)
    return C.cluster_distribution(rows.select("id", F.col("group").alias("cluster"), "weight"))


@query("named_clusters", HAM + "SELECT id, ['low', 'mid', 'high'][g + 1] AS cluster FROM r")
def _(spark, d):
    _, rows = _ham(spark, d)
    return C.named_clusters(rows.select("id", F.col("group").alias("cluster")), {0: "low", 1: "mid", 2: "high"})


FUZZY = HAM + """, mm AS (SELECT r.id, r.g, round(coalesce(sum(b.wj * b.d), 0), 6) AS total FROM r LEFT JOIN b ON b.i = r.id AND b.gi = b.gj GROUP BY r.id, r.g), md AS (SELECT g, arg_min(id, (total, id)) AS m FROM mm GROUP BY g),
 ms AS (SELECT r.id, md.g, md.m, r.w, CASE WHEN r.g = md.g THEN 0.6 ELSE 0.2 END AS u FROM r, md), dd AS (SELECT ms.*, coalesce((SELECT any_value(b.d) FROM b WHERE b.i = ms.id AND b.j = ms.m), 0) AS d FROM ms),
 pe AS (SELECT g, m, sum(w * u * d) / sum(w * u) AS ra, sum(w * u * d) AS sp, sum(w * u) AS ma FROM dd GROUP BY g, m), ap AS (SELECT x.g, x.ra + y.ra AS s, (SELECT any_value(b.d) FROM b WHERE b.i = x.m AND b.j = y.m) AS d FROM pe x, pe y WHERE x.g <> y.g)
 SELECT round((SELECT avg(w) FROM (SELECT max(s / d) AS w FROM ap GROUP BY g)), 6) AS db, round(((SELECT max(d) FROM ap) / (SELECT sum(sp) / sum(ma) FROM pe) / (SELECT count(*) FROM pe)) ** 2, 6) AS pbm, round((SELECT sum(sp) / sum(ma) FROM pe) / (SELECT min(d) FROM ap), 6) AS xb"""


@query("fuzzy_indices", FUZZY)
def _(spark, d):
    pairs, rows = _sums(spark, d)
    medoids = R.medoids(pairs, rows).select(F.col("group").alias("cluster"), "medoid")
    memberships = rows.select("id", F.explode(F.array(*[F.struct(F.lit(g).alias("cluster"), F.when(F.col("group") == g, 0.6).otherwise(0.2).alias("u")) for g in range(3)])).alias("x")).select("id", "x.cluster", "x.u")
    return C.fuzzy_indices(pairs, memberships, medoids, rows)


@query("fuzzy_medoids_possibilistic")
def _(spark, d):
    return C.fuzzy_medoids(*_panel(spark, d), k=3, kind="PCMdd")


@query("fuzzy_medoids_hard_noise")
def _(spark, d):
    return C.fuzzy_medoids(*_panel(spark, d), k=3, noise=18.0, kind="HNCdd")


@query("association_statistics")
def _(spark, d):
    return A.association_test(*_ham(spark, d), 49)


@query("partition_quality", HAM + """, X AS (SELECT d, gi = gj AS same, gi AS c, wi * wj AS w FROM hw), m AS (SELECT sum(w) AS W, sum(w * d) AS D, sum(w * d * d) AS DD, sum(w) FILTER (NOT same) AS X, sum(w * d) FILTER (NOT same) AS XD, sum(w) FILTER (same) AS WS, sum(w * d) FILTER (same) AS DS FROM X),
 v AS (SELECT sum(s / W) AS SW, sum(q / W) AS QW FROM (SELECT c AS g, sum(w * d) AS s, sum(w * d * d) AS q FROM X WHERE same GROUP BY c) JOIN gw USING (g)),
 cc AS (SELECT sum(CASE WHEN a.d < o.d THEN a.w * o.w ELSE 0 END) AS plus, sum(CASE WHEN a.d > o.d THEN a.w * o.w ELSE 0 END) AS minus, sum(a.w * o.w) AS al FROM (SELECT d, sum(w) AS w FROM X WHERE same GROUP BY d) a, (SELECT d, sum(w) AS w FROM X WHERE NOT same GROUP BY d) o),
 od AS (SELECT d, w, sum(w) OVER (ORDER BY d, i, j) AS up, sum(w) OVER (ORDER BY d DESC, i, j) AS dn FROM (SELECT d, i, j, wi * wj AS w FROM hw)), lm AS (SELECT sum(od.d * od.w) FILTER (up <= WS) AS least, sum(od.d * od.w) FILTER (dn <= WS) AS most FROM od, m)
 SELECT W.W AS n, W.k, round((XD / m.W - X / m.W * D / m.W) / sqrt((DD / m.W - (D / m.W) ** 2) * (X / m.W - (X / m.W) ** 2)), 6) AS pbc, round((plus - minus) / (plus + minus), 6) AS hg, round((plus - minus) / al, 6) AS hgsd, round((DS - least) / (most - least), 6) AS hc,
 round(((D / W.W - SW) / (k - 1)) / (SW / (W.W - k)), 6) AS ch, round(1 - SW / (D / W.W), 6) AS r2, round(((DD / W.W - QW) / (k - 1)) / (QW / (W.W - k)), 6) AS chsq, round(1 - QW / (DD / W.W), 6) AS r2sq FROM m, v, cc, lm, tw W""")
def _(spark, d):
    pairs, rows = _ham(spark, d)
    return C.partition_quality(pairs, rows.select("id", F.col("group").alias("cluster"), "weight")).drop("asw", "asww")


@query("label_agreement", f"WITH {fx.SQL['ev_daily']}, l AS (SELECT DISTINCT id, id % 3 AS a, id % 4 AS b FROM p), t AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS N FROM t), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM t GROUP BY a)), q AS (SELECT sum(n * (n - 1) / 2) AS q FROM (SELECT sum(n) AS n FROM t GROUP BY b)) SELECT round((c - r * q / (N * (N - 1) / 2)) / ((r + q) / 2 - r * q / (N * (N - 1) / 2)), 6) AS ari, round(c / (r + q - c), 6) AS jaccard FROM c, r, q")
def _(spark, d):
    ids = fx.ev_daily(spark, d).long.select("id").distinct()
    return C.agreement(ids.select("id", (F.col("id") % 3).alias("cluster")), ids.select("id", (F.col("id") % 4).alias("cluster")))


@query("aggregate_cases", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY ALL")
def _(spark, d):
    from trajectra.sources.tables import table

    return C.aggregate_cases(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("marginal_association", " UNION ALL ".join("SELECT * FROM (" + HAM.replace("uid % 3", f"uid % {m}") + LEV + f" SELECT '{f}' AS factor, round(((st.ss - sw.ss) / (k - 1)) / (sw.ss / (W - k)), 6) AS pseudo_f, round(1 - sw.ss / st.ss, 6) AS pseudo_r2, round(levene, 6) AS levene FROM st, sw, tw, lt)" for f, m in (("third", 3), ("half", 2))))
def _(spark, d):
    pairs, rows = _ham(spark, d)
    rows = rows.select("id", "weight", (F.col("id") % 3).alias("third"), (F.col("id") % 2).alias("half"))
    return A.marginal_association(pairs, rows, ["third", "half"])


TRIM = ", qc AS (SELECT g, quantile_cont(dc, 0.8) AS c FROM dc GROUP BY g), kp AS (SELECT dc.id, dc.g, dc.w FROM dc JOIN qc ON qc.g = dc.g WHERE dc <= c + 1e-12), kw AS (SELECT g, sum(w) AS W FROM kp GROUP BY g), ks AS (SELECT x.g, sum(x.w * y.w * h.d) AS s FROM h JOIN kp x ON x.id = h.i JOIN kp y ON y.id = h.j WHERE x.g = y.g GROUP BY x.g), ts AS (SELECT b.i, sum(b.wj * b.d) AS s FROM b JOIN kp ON kp.id = b.j AND kp.g = b.gi GROUP BY b.i)"


@query("trimmed_center", HAM + LEV + TRIM + ' SELECT r.id, r.g AS "group", r.w AS weight, round(coalesce(ts.s, 0) / kw.W - coalesce(ks.s, 0) / kw.W / kw.W, 6) AS dc, kp.id IS NOT NULL AS kept FROM r LEFT JOIN ts ON ts.i = r.id JOIN kw ON kw.g = r.g LEFT JOIN ks ON ks.g = r.g LEFT JOIN kp ON kp.id = r.id')
def _(spark, d):
    return R.trimmed_center(*_ham(spark, d))


for _criterion in ("freq", "dist", "random"):

    @query(f"representatives_{_criterion}")
    def _(spark, d, criterion=_criterion):
        pairs, rows = _sums(spark, d)
        return R.representatives(pairs, rows.select("id", "weight"), share=0.7, criterion=criterion)
