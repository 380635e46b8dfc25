"""Sequence tables over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectra.operators import sequences
from trajectra.operators.sequences import SequenceFrame

from .tables import table

# Fixed values of the tables' columns, in sorted order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")
ROLES = ("assistant", "system", "user")
BANDS = ("high", "low", "mid")
DAYS = 31


def ev_all(spark: SparkSession, sf_dir: str) -> SequenceFrame:
    """All events of each user, of any number."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return sequences.from_events(events, "user_id", ["ts", "event_id"], "event_type", EVENT_TYPES)


def _daily(spark: SparkSession, sf_dir: str, state: Column, states: tuple[str, ...]) -> SequenceFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state.alias("state"), F.dayofmonth("ts").alias("day"))
    return sequences.from_time_grid(events, "user_id", "day", ["ts", "event_id"], "state", states, range(1, DAYS + 1))


def ev_daily(spark: SparkSession, sf_dir: str) -> SequenceFrame:
    """The last event of each user per day of the month, carried forward; missing before the first."""
    return _daily(spark, sf_dir, F.col("event_type"), EVENT_TYPES)


def bands_daily(spark: SparkSession, sf_dir: str) -> SequenceFrame:
    """A second domain of ev_daily: the band of the same events' values."""
    return _daily(spark, sf_dir, _band(), BANDS)


def ord_seq(spark: SparkSession, sf_dir: str) -> SequenceFrame:
    """The priorities of each customer's orders, of any number."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return sequences.from_events(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority", PRIORITIES)


def ord_status(spark: SparkSession, sf_dir: str) -> SequenceFrame:
    """The statuses of each customer's orders, of any number."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return sequences.from_events(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", STATUSES)


def _band() -> Column:
    return F.when(F.col("value") < 30, "low").when(F.col("value") < 100, "mid").otherwise("high")


def bands_all(spark: SparkSession, sf_dir: str) -> SequenceFrame:
    """A second domain of ev_all: the band of the same events' values."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", _band().alias("band"))
    return sequences.from_events(events, "user_id", ["ts", "event_id"], "band", BANDS)


def conv_roles(spark: SparkSession, sf_dir: str) -> SequenceFrame:
    """The roles of each conversation by turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sequences.from_events(turns, "conv_id", ["turn"], "role", ROLES)


def tse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped events: (id, ts in hours, event)."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("ts"), F.col("event_type").alias("event"), F.col("event_id").alias("seq_no"))


def _codes(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _daily_sql(state: str, states: tuple[str, ...], name: str) -> str:
    return f"""{name}_latest AS (SELECT user_id AS id, day(ts) AS t, arg_max({state}, (ts, event_id)) AS state FROM events GROUP BY ALL),
      {name}_grid AS (SELECT id, t FROM (SELECT DISTINCT id FROM {name}_latest), (SELECT unnest(range(1, {DAYS + 1})) AS t)),
      {name} AS (SELECT id, t AS pos, coalesce(list_position({_codes(states)}, last_value(state IGNORE NULLS) OVER (PARTITION BY id ORDER BY t)), {len(states) + 1}) AS s FROM {name}_grid LEFT JOIN {name}_latest USING (id, t))"""


_BAND = "CASE WHEN value < 30 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END"
#: CTE "p" with (id, pos, s) for each fixture, "p2" for those of a second domain.
SQL = {
    "ev_all": f"""p AS (SELECT user_id AS id, list_position({_codes(EVENT_TYPES)}, event_type) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)""",
    "ev_daily": _daily_sql("event_type", EVENT_TYPES, "p"),
    "bands_daily": _daily_sql(_BAND, BANDS, "p2"),
    "ord_seq": f"""p AS (SELECT o_custkey AS id, list_position({_codes(PRIORITIES)}, o_orderpriority) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders)""",
    "ord_status": f"""p AS (SELECT o_custkey AS id, list_position({_codes(STATUSES)}, o_orderstatus) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders)""",
    "bands_all": f"""p2 AS (SELECT user_id AS id, list_position({_codes(BANDS)}, {_BAND}) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)""",
    "conv_roles": f"""p AS (SELECT conv_id AS id, list_position({_codes(ROLES)}, role) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)""",
}
#: CTE "sp" with (id, k, s, b, d): spells of "p".
SPELLS_SQL = """marked AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS c FROM p),
  numbered AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY pos) AS k FROM marked),
  sp AS (SELECT id, CAST(k AS BIGINT) AS k, any_value(s) AS s, min(pos) AS b, count(*) AS d FROM numbered GROUP BY id, k)"""
