"""Queries on pairs of sequences."""

from __future__ import annotations

from trajectra.operators import distances as D
from trajectra.operators import transition_matching as TM
from trajectra.operators import transitions as T
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


EV, DAILY = fx.SQL["ev_all"], fx.SQL["ev_daily"]
#: CTE "u": distinct sequences by least id, as lists; "pr": their pairs.
UNIQUE = f"WITH RECURSIVE {EV}, arr AS (SELECT id, list(s ORDER BY pos) AS q FROM p GROUP BY id), u AS (SELECT min(id) AS uid, q FROM arr GROUP BY q), pr AS (SELECT a.uid AS i, b.uid AS j, a.q AS x, b.q AS y FROM u a JOIN u b ON a.uid < b.uid)"
#: The same over the daily panel: six states, equal lengths.
PANEL = UNIQUE.replace(EV, DAILY)
#: CTE "sp": spells; "pr" with the spells' states and lengths.
SPELLS = f"WITH {EV}, {fx.SPELLS_SQL}, sa AS (SELECT id, list(s ORDER BY k) AS q, list(d ORDER BY k) AS d FROM sp GROUP BY id), arr AS (SELECT id, list(s ORDER BY pos) AS f FROM p GROUP BY id), u AS (SELECT min(id) AS uid, any_value(q) AS q, any_value(d) AS d FROM sa JOIN arr USING (id) GROUP BY f), pr AS (SELECT a.uid AS i, b.uid AS j, a.q AS x, b.q AS y, a.d AS dx, b.d AS dy FROM u a JOIN u b ON a.uid < b.uid)"


def _edit_sql(head: str, sub: str, indel: float, value: str) -> str:
    """OM by a recursive row of the table; ``sub`` is the cost of x[r + 1] against y[c]."""
    return head + f""", dp AS (
      SELECT i, j, x, y, CAST(0 AS BIGINT) AS r, list_transform(range(0, len(y) + 1), lambda c: c * {indel}::DOUBLE) AS row FROM pr
      UNION ALL
      SELECT i, j, x, y, r + 1, list_reduce(list_prepend([(r + 1) * {indel}::DOUBLE], list_transform(range(1, len(y) + 1), lambda c: [least(row[c + 1] + {indel}, row[c] + {sub})])),
        lambda a, b: list_append(a, least(b[1], a[len(a)] + {indel}))) FROM dp WHERE r < len(x))
    SELECT i, j, round({value}, 6) AS d FROM dp WHERE r = len(x)"""


def _items_sql(head: str, sub: str, dele: str, ins: str, extra: str = "", border: bool = True) -> str:
    """The same with costs by item: ``sub`` of x[r + 1] against y[c], ``dele`` of x[r + 1], ``ins`` of y[c]; ``extra`` are columns of pr."""
    keep = "i, j, x, y" + (f", {extra}" if extra else "")
    edge = f"coalesce(list_sum(list_transform(range(1, c + 1), lambda t: {ins.replace('[c]', '[t]')})), 0)::DOUBLE"
    return head + f""", dp AS (
      SELECT {keep}, CAST(0 AS BIGINT) AS r, list_transform(range(0, len(y) + 1), lambda c: {edge}) AS row FROM pr
      UNION ALL
      SELECT {keep}, r + 1, list_reduce(list_prepend([(row[1] + {dele})::DOUBLE], list_transform(range(1, len(y) + 1), lambda c: [least(row[c + 1] + {dele}, row[c] + {sub})::DOUBLE])),
        lambda a, b: list_append(a, least(b[1], a[len(a)] + {ins.replace('[c]', '[len(a)]')}))) FROM dp WHERE r < len(x))
    SELECT i, j, round(row[len(y) + 1], 6) AS d FROM dp WHERE r = len(x)"""


@query("dist_om", _edit_sql(UNIQUE, "CASE WHEN x[r + 1] = y[c] THEN 0 ELSE 1.5 END", 1.0, "row[len(y) + 1]"))
def _(spark, d):
    frame = fx.ev_all(spark, d)
    return D.pairwise(frame, "OM", costs=[[0.0 if a == b else 1.5 for b in range(5)] for a in range(5)], indel=1.0)


@query("dist_om_rates")
def _(spark, d):
    return D.pairwise(fx.ord_seq(spark, d), "OM", costs="RATE", norm="auto")


@query("dist_lcs", _edit_sql(UNIQUE, "CASE WHEN x[r + 1] = y[c] THEN 0 ELSE 2 END", 1.0, "row[len(y) + 1]"))
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "LCS")


@query("dist_om_as_lcs", _edit_sql(UNIQUE, "CASE WHEN x[r + 1] = y[c] THEN 0 ELSE 6 END", 1.5, "row[len(y) + 1] / (1.5 * greatest(len(x), len(y)))"))
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "OM", costs=[[0.0 if a == b else 6.0 for b in range(5)] for a in range(5)], indel=1.5, norm="auto")


@query("dist_ham", PANEL + " SELECT i, j, CAST(list_sum(list_transform(range(1, 32), lambda t: CASE WHEN x[t] = y[t] THEN 0 ELSE 1 END)) AS DOUBLE) AS d FROM pr")
def _(spark, d):
    return D.pairwise(fx.ev_daily(spark, d), "HAM")


DHD = PANEL + """, m AS (SELECT id, pos, s AS s1, lead(s) OVER (PARTITION BY id ORDER BY pos) AS s2 FROM p), ct AS (SELECT pos, s1, s2, count(*) AS n FROM m WHERE s2 IS NOT NULL GROUP BY ALL), rt AS (SELECT pos, s1, s2, n / sum(n) OVER (PARTITION BY pos, s1) AS rate FROM ct),
 g AS (SELECT t AS pos, s1, s2 FROM (SELECT unnest(range(1, 7)) AS s1), (SELECT unnest(range(1, 7)) AS s2), (SELECT unnest(range(1, 32)) AS t)),
 q AS (SELECT g.*, coalesce(a.rate, 0) + coalesce(b.rate, 0) + coalesce(c.rate, 0) + coalesce(e.rate, 0) AS v FROM g
  LEFT JOIN rt a ON a.pos = g.pos AND a.s1 = g.s1 AND a.s2 = g.s2 LEFT JOIN rt b ON b.pos = g.pos AND b.s1 = g.s2 AND b.s2 = g.s1
  LEFT JOIN rt c ON c.pos = g.pos - 1 AND c.s1 = g.s1 AND c.s2 = g.s2 LEFT JOIN rt e ON e.pos = g.pos - 1 AND e.s1 = g.s2 AND e.s2 = g.s1),
 cost AS (SELECT pos, s1, s2, CASE WHEN s1 = s2 THEN 0 ELSE greatest(0, 4 - CASE WHEN pos IN (1, 31) THEN 2 * v ELSE v END) END AS c FROM q),
 ex AS (SELECT i, j, t, x[t] AS s1, y[t] AS s2 FROM pr, (SELECT unnest(range(1, 32)) AS t))
 SELECT i, j, round(sum(c), 6) AS d FROM ex JOIN cost ON cost.pos = t AND cost.s1 = ex.s1 AND cost.s2 = ex.s2 GROUP BY i, j"""


@query("dist_dhd", DHD)
def _(spark, d):
    frame = fx.ev_daily(spark, d)
    table = [[[0.0] * frame.n_states for _ in range(frame.n_states)] for _ in range(fx.DAYS)]
    for row in T.rate_costs_by_time(frame, fx.DAYS).collect():  # positions times the alphabet squared
        table[row.pos - 1][row.s1 - 1][row.s2 - 1] = row.cost
    return D.pairwise(frame, "DHD", costs=table)


LCP = "coalesce(list_min(list_filter(range(1, least(len({x}), len({y})) + 1), lambda t: {x}[t] <> {y}[t])) - 1, least(len({x}), len({y})))"


@query("dist_lcp", UNIQUE + f" SELECT i, j, CAST(len(x) + len(y) - 2 * {LCP.format(x='x', y='y')} AS DOUBLE) AS d FROM pr")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "LCP")


@query("dist_rlcp", UNIQUE + f", rv AS (SELECT i, j, list_reverse(x) AS x, list_reverse(y) AS y FROM pr) SELECT i, j, round(1 - 2 * {LCP.format(x='x', y='y')} / (2 * sqrt(len(x)) * sqrt(len(y))), 6) AS d FROM rv")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "RLCP", norm="auto")


SPL = SPELLS + f", l AS (SELECT *, {LCP.format(x='x', y='y')} AS c FROM pr)"
GAP = "coalesce(list_sum(list_transform(range(1, c + 1), lambda t: {f})), 0)"


@query("dist_lcpspell", SPL + f" SELECT i, j, round(CAST(len(x) + len(y) - 2 * c + {GAP.format(f='abs(dx[t] - dy[t])')} / 2 AS DOUBLE), 6) AS d FROM l")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "LCPspell")


@query("dist_lcpmst", SPL + f" SELECT i, j, round(1 - 2 * {GAP.format(f='least(dx[t], dy[t])')} / (list_sum(dx) + list_sum(dy)), 6) AS d FROM l")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "LCPmst", norm="auto")


@query("dist_lcpprod", SPL + f" SELECT i, j, CAST(list_sum(list_transform(dx, lambda v: v * v)) + list_sum(list_transform(dy, lambda v: v * v)) - 2 * {GAP.format(f='dx[t] * dy[t]')} AS DOUBLE) AS d FROM l")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "LCPprod")


@query("dist_euclid", PANEL + " SELECT i, j, round(sqrt(list_sum(list_transform(range(1, 32), lambda t: CASE WHEN x[t] = y[t] THEN 0 ELSE 1 END)) / 31), 6) AS d FROM pr")
def _(spark, d):
    return D.pairwise(fx.ev_daily(spark, d), "EUCLID", norm="auto")


@query("dist_chi2", PANEL + """, ex AS (SELECT uid, (t - 1) // 5 AS b, q[t] AS c FROM (SELECT uid, q, unnest(range(1, 32)) AS t FROM u)),
 cells AS (SELECT uid, b, c FROM u, (SELECT unnest(range(0, 7)) AS b), (SELECT unnest(range(1, 7)) AS c)),
 prof AS (SELECT cells.uid, cells.b, cells.c, count(ex.uid) / least(5, 31 - 5 * any_value(cells.b)) AS f FROM cells LEFT JOIN ex ON ex.uid = cells.uid AND ex.b = cells.b AND ex.c = cells.c GROUP BY ALL),
 mass AS (SELECT b, c, n / sum(n) OVER (PARTITION BY b) AS m FROM (SELECT (pos - 1) // 5 AS b, s AS c, count(*) AS n FROM p GROUP BY ALL))
 SELECT x.uid AS i, y.uid AS j, round(sqrt(sum((x.f - y.f) ** 2 / m)), 6) AS d FROM prof x JOIN prof y ON x.uid < y.uid AND x.b = y.b AND x.c = y.c JOIN mass ON mass.b = x.b AND mass.c = x.c GROUP BY ALL""")
def _(spark, d):
    return D.pairwise(fx.ev_daily(spark, d), "CHI2", step=5)


@query("dist_references", PANEL + " SELECT uid AS i, CAST(r AS INT) AS ref, CAST(list_sum(list_transform(range(1, 32), lambda t: CASE WHEN q[t] = [1, 5][r + 1] THEN 0 ELSE 1 END)) AS DOUBLE) AS d FROM u, (SELECT unnest([0, 1]) AS r)")
def _(spark, d):
    return D.to_references(fx.ev_daily(spark, d), [[1] * fx.DAYS, [5] * fx.DAYS], "HAM")


@query("dist_expanded", f"WITH {fx.SQL['conv_roles']}, arr AS (SELECT id, list(s ORDER BY pos) AS q FROM p GROUP BY id), pr AS (SELECT a.id AS i, b.id AS j, a.q AS x, b.q AS y FROM arr a JOIN arr b ON a.id < b.id) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(len(x) + len(y) - 2 * {LCP.format(x='x', y='y')} AS DOUBLE) AS d FROM pr")
def _(spark, d):
    frame = fx.conv_roles(spark, d)
    return D.expand(frame, D.pairwise(frame, "LCP"))


@query("dist_elzinga_studer", PANEL + ", h AS (SELECT i, j, list_sum(list_transform(range(1, 32), lambda t: CASE WHEN x[t] = y[t] THEN 0 ELSE 1 END)) AS d FROM pr), r AS (SELECT uid, list_sum(list_transform(q, lambda s: CASE WHEN s = 1 THEN 0 ELSE 1 END)) AS r FROM u) SELECT i, j, round(CASE WHEN d + a.r + b.r > 0 THEN 2 * d / (d + a.r + b.r) ELSE 0 END, 6) AS d FROM h JOIN r a ON a.uid = i JOIN r b ON b.uid = j")
def _(spark, d):
    return D.elzinga_studer_pairs(fx.ev_daily(spark, d), [1] * fx.DAYS, "HAM")


def _plain(name: str, method: str, source=fx.ev_all, **options) -> None:
    @query(name)
    def _(spark, d):
        return D.pairwise(source(spark, d), method, **options)




def _met(item: str, one: str, other: str) -> str:
    """An indel of OMloc: a tenth of the largest cost, two, and four tenths of the costs to the two items met."""
    return f"(0.2 + 0.8 * (CASE WHEN {item} = {one} THEN 0 ELSE 1 END + CASE WHEN {item} = {other} THEN 0 ELSE 1 END))"


_DELETED = f"CASE WHEN c > 1 THEN {_met('x[r + 1]', 'y[c - 1]', 'y[c]')} WHEN r = 0 THEN {_met('x[1]', 'y[1]', 'y[1]')} ELSE {_met('x[r + 1]', 'y[len(y)]', 'y[len(y)]')} END"


@query("dist_omloc", UNIQUE + f""", dp AS (
      SELECT i, j, x, y, CAST(0 AS BIGINT) AS r, list_transform(range(0, len(y) + 1), lambda c: coalesce(list_sum(list_transform(range(1, c + 1), lambda t: {_met('y[t]', 'x[1]', 'x[1]')})), 0)::DOUBLE) AS row FROM pr
      UNION ALL
      SELECT i, j, x, y, r + 1, list_reduce(list_prepend([(CASE WHEN r = 0 THEN {_met('x[1]', 'y[1]', 'y[1]')} ELSE list_sum(list_transform(range(1, r + 2), lambda t: {_met('x[t]', 'y[len(y)]', 'y[len(y)]')})) END)::DOUBLE],
          list_transform(range(1, len(y) + 1), lambda c: [least(row[c + 1] + {_DELETED}, row[c] + CASE WHEN x[r + 1] = y[c] THEN 0 ELSE 2 END)::DOUBLE])),
        lambda a, b: list_append(a, least(b[1], a[len(a)] + {_met('y[len(a)]', 'x[greatest(r, 1)]', 'x[r + 1]')}))) FROM dp WHERE r < len(x))
    SELECT i, j, round(row[len(y) + 1], 6) AS d FROM dp WHERE r = len(x)""")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "OMloc", expansion=0.1)


_plain("dist_omspell", "OMspell", source=fx.ord_seq, indel=1.0)
_plain("dist_twed", "TWED", source=fx.ord_seq)
#: Common subsequences of every length are counted in a table per pair, so these take short sequences.
_plain("dist_nms", "NMS", source=fx.conv_roles)
_plain("dist_nmsmst", "NMSMST", source=fx.conv_roles)
_plain("dist_svrspell", "SVRspell", source=fx.conv_roles)

RECURSIVE_SPELLS = SPELLS.replace("WITH ", "WITH RECURSIVE ", 1)


def _spell_sql(u: str, v: str) -> str:
    """OM on spells whose durations cost ``u`` for x's item and ``v`` for y's, with substitutions of two and indels of one."""
    return _items_sql(RECURSIVE_SPELLS, f"CASE WHEN x[r + 1] = y[c] THEN abs(({u}) - ({v})) ELSE 2 + ({u}) + ({v}) END", f"(1 + ({u}))", f"(1 + ({v}))", "dx, dy")


TOKENS = "[1.0, 0.5, 2.0, 1.0, 0.5]"


@query("dist_omspell_events", _spell_sql("0.5 * (dx[r + 1] - 1)", "0.5 * (dy[c] - 1)"))
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "OMspell", indel=1.0)


@query("dist_omspellrs", _spell_sql("0.5 * dx[r + 1] / 4.0", "0.5 * dy[c] / 4.0"))
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "OMspellRS", indel=1.0, reference=4.0)


@query("dist_omtspell", _spell_sql(f"0.5 * {TOKENS}[x[r + 1]] * (dx[r + 1] - 1)", f"0.5 * {TOKENS}[y[c]] * (dy[c] - 1)"))
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "OMtspell", indel=1.0, tokens=[1.0, 0.5, 2.0, 1.0, 0.5])


LONG = f"WITH RECURSIVE {EV}, {fx.SPELLS_SQL}, arr AS (SELECT p.id, list(p.s ORDER BY pos) AS q, list(1 / sqrt(sp.d) ORDER BY pos) AS t FROM p JOIN sp ON sp.id = p.id AND pos >= b AND pos < b + d GROUP BY p.id), pr AS (SELECT a.id AS i, b.id AS j, a.q AS x, b.q AS y, a.t AS tx, b.t AS ty FROM arr a JOIN arr b ON a.id < b.id)"


@query("dist_omslen", _items_sql(LONG, "CASE WHEN x[r + 1] = y[c] THEN 0 ELSE tx[r + 1] + ty[c] END", "tx[r + 1]", "ty[c]", "tx, ty"))
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "OMslen", indel=1.0)


MOVES = f"WITH RECURSIVE {EV}, arr AS (SELECT id, list(s ORDER BY pos) AS q, list(n ORDER BY pos) AS n FROM (SELECT id, pos, s, coalesce(lead(s) OVER (PARTITION BY id ORDER BY pos), s) AS n FROM p) GROUP BY id), pr AS (SELECT a.id AS i, b.id AS j, a.q AS x, b.q AS y, a.n AS nx, b.n AS ny FROM arr a JOIN arr b ON a.id < b.id)"


@query("dist_omstran", _items_sql(MOVES, "CASE WHEN x[r + 1] = y[c] THEN 0 ELSE 1 END + CASE WHEN (x[r + 1] <> y[c] OR nx[r + 1] <> ny[c]) AND (x[r + 1] <> nx[r + 1] OR y[c] <> ny[c]) THEN 1 ELSE 0 END", "1.0", "1.0", "nx, ny"))
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "OMstran")


RATES = UNIQUE + ", m AS (SELECT id, s AS s1, lead(s) OVER (PARTITION BY id ORDER BY pos) AS s2 FROM p), ct AS (SELECT s1, s2, count(*) AS n FROM m WHERE s2 IS NOT NULL GROUP BY ALL), rt AS (SELECT s1, s2, n / sum(n) OVER (PARTITION BY s1) AS rate FROM ct), ab AS (SELECT a AS s1, b AS s2 FROM (SELECT unnest(range(1, 6)) AS a), (SELECT unnest(range(1, 6)) AS b)), co AS (SELECT ab.s1, ab.s2, CASE WHEN ab.s1 = ab.s2 THEN 0 ELSE 2 - coalesce(x.rate, 0) - coalesce(y.rate, 0) END AS c FROM ab LEFT JOIN rt x ON x.s1 = ab.s1 AND x.s2 = ab.s2 LEFT JOIN rt y ON y.s1 = ab.s2 AND y.s2 = ab.s1), cm AS (SELECT list(c ORDER BY s1, s2) AS m, max(c) / 2 AS e FROM co)"


@query("dist_om_rates_events", _items_sql(RATES.replace("pr AS (SELECT", "pr0 AS (SELECT") + ", pr AS (SELECT * FROM pr0, cm)", "m[(x[r + 1] - 1) * 5 + y[c]]", "e", "e", "m, e"))
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "OM", costs="RATE")


#: Stiffness and penalty of one half, so an indel of 2 * 1 * 2 + 1; the first row and column can't be warped into.
_PAIR = "(CASE WHEN x[r + 1] = y[c] AND (CASE WHEN r = 0 THEN 0 ELSE x[r] END) = (CASE WHEN c = 1 THEN 0 ELSE y[c - 1] END) THEN 0 ELSE CASE WHEN x[r + 1] = y[c] THEN 0 ELSE 2 END + CASE WHEN r = 0 OR c = 1 OR x[r] = y[c - 1] THEN 0 ELSE 2 END END)"


@query("dist_twed_events", UNIQUE + f""", dp AS (
      SELECT i, j, x, y, CAST(0 AS BIGINT) AS r, list_transform(range(0, len(y) + 1), lambda c: c * 5.0::DOUBLE) AS row FROM pr
      UNION ALL
      SELECT i, j, x, y, r + 1, list_reduce(list_prepend([(r + 1) * 5.0::DOUBLE], list_transform(range(1, len(y) + 1), lambda c: [least(
          CASE WHEN (r = 0) = (c = 1) THEN row[c] + {_PAIR} + abs(r + 1 - c) ELSE 1e300 END,
          CASE WHEN r > 0 THEN row[c + 1] + 1 + CASE WHEN x[r + 1] = x[r] THEN 0 ELSE 2 END ELSE 1e300 END)])),
        lambda a, b: list_append(a, CASE WHEN len(a) = 1 THEN b[1] ELSE least(b[1], a[len(a)] + 1 + CASE WHEN y[len(a)] = y[len(a) - 1] THEN 0 ELSE 2 END) END)) FROM dp WHERE r < len(x))
    SELECT i, j, round(row[len(y) + 1], 6) AS d FROM dp WHERE r = len(x)""")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "TWED")


RSP = SPELLS + f", rv AS (SELECT i, j, list_reverse(x) AS x, list_reverse(y) AS y, list_reverse(dx) AS dx, list_reverse(dy) AS dy FROM pr), l AS (SELECT *, {LCP.format(x='x', y='y')} AS c FROM rv)"


@query("dist_rlcpspell", RSP + f" SELECT i, j, round((len(x) + len(y) - 2 * c + {GAP.format(f='abs(dx[t] - dy[t])')} / 2) / (len(x) + len(y) + 0.5 * least(len(x), len(y))), 6) AS d FROM l")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "RLCPspell", norm="auto")


@query("dist_rlcpmst", RSP + f" SELECT i, j, CAST(list_sum(dx) + list_sum(dy) - 2 * {GAP.format(f='least(dx[t], dy[t])')} AS DOUBLE) AS d FROM l")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "RLCPmst")


@query("dist_rlcpprod", RSP + f" SELECT i, j, CAST(list_sum(list_transform(dx, lambda v: v * v)) + list_sum(list_transform(dy, lambda v: v * v)) - 2 * {GAP.format(f='dx[t] * dy[t]')} AS DOUBLE) AS d FROM l")
def _(spark, d):
    return D.pairwise(fx.ev_all(spark, d), "RLCPprod")


@query("dist_custom", UNIQUE + " SELECT i, j, CAST(abs(len(x) - len(y)) + CASE WHEN x[1] = y[1] THEN 0 ELSE 1 END AS DOUBLE) AS d FROM pr")
def _(spark, d):
    return D.custom(fx.ev_all(spark, d), lambda x, y: float(abs(len(x) - len(y)) + (x[0] != y[0])))


#: Rates of transition "rt", and for each position its neighbours "b" and "n", and what the moves around it count, a quarter (an eighth with both neighbours) of each.
_MOVES = f"""WITH RECURSIVE {EV}, st AS (SELECT id, pos, s, coalesce(lag(s) OVER w, s) AS b, coalesce(lead(s) OVER w, s) AS n, lead(s) OVER w AS s2 FROM p WINDOW w AS (PARTITION BY id ORDER BY pos)),
  rt AS (SELECT s, s2, count(*) / sum(count(*)) OVER (PARTITION BY s) AS rate FROM st WHERE s2 IS NOT NULL GROUP BY s, s2),
  tk AS (SELECT st.id, st.pos, st.s, {{token}} AS k, {{part}} AS t FROM st LEFT JOIN rt o ON o.s = st.s AND o.s2 = st.n LEFT JOIN rt i ON i.s = st.b AND i.s2 = st.s),
  arr AS (SELECT id, list(s ORDER BY pos) AS q, list(k ORDER BY pos) AS k, list(t ORDER BY pos) AS t FROM tk GROUP BY id),
  pr AS (SELECT a.id AS i, b.id AS j, a.q AS x, b.q AS y, a.k AS kx, b.k AS ky, a.t AS tx, b.t AS ty FROM arr a JOIN arr b ON a.id < b.id)"""
_MATCHED = ("CASE WHEN kx[r + 1] = ky[c] THEN 0 ELSE CASE WHEN x[r + 1] = y[c] THEN 0 ELSE 0.5 END + tx[r + 1] + ty[c] END", "(0.25 + tx[r + 1])", "(0.25 + ty[c])", "kx, ky, tx, ty")
_NEXT, _BOTH = "st.s * 10 + st.n", "st.b * 100 + st.s * 10 + st.n"
_PARTS = {
    ("constant", False): "CASE WHEN st.s = st.n THEN 0 ELSE 0.25 END",
    ("rate", False): "CASE WHEN st.s = st.n THEN 0 ELSE 0.25 * (1 - coalesce(o.rate, 0)) END",
    ("constant", True): "CASE WHEN st.b = st.s THEN 0 ELSE 0.125 END + CASE WHEN st.s = st.n THEN 0 ELSE 0.125 END",
    ("rate", True): "0.125 * (2 - coalesce(i.rate, 0) - coalesce(o.rate, 0))",
}

for (_kind, _previous), _part in _PARTS.items():

    @query(f"transition_matching_{_kind}{'_both' if _previous else ''}", _items_sql(_MOVES.format(token=_BOTH if _previous else _NEXT, part=_part), *_MATCHED))
    def _(spark, d, kind=_kind, previous=_previous):
        return TM.transition_matching(fx.ev_all(spark, d), kind, previous)


#: Costs by the distance of the states' numbers, at most 4, so shares are quarters; the moves count as much.
@query(
    "transition_matching_cost",
    _items_sql(_MOVES.format(token=_NEXT, part="0.25 * abs(st.s - st.n) / 4"), "CASE WHEN kx[r + 1] = ky[c] THEN 0 ELSE 0.5 * abs(x[r + 1] - y[c]) / 4 + tx[r + 1] + ty[c] END", *_MATCHED[1:]),
)
def _(spark, d):
    return TM.transition_matching(fx.ev_all(spark, d), "cost", costs=[[abs(a - b) for b in range(5)] for a in range(5)])
