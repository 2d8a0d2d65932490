"""The registry of queries, and the business frames that they take from the tables, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows where there is such SQL."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_ts(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def dbl(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: dbl(n) for n in names})


def times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: text_ts(n) for n in names})


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reservations of a guest at a property (the guest's nation)."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    status = F.when(F.col("o_orderstatus") == "F", "CHECKED_OUT").when(F.col("o_orderstatus") == "O", "BOOKED").otherwise("CANCELLED")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("reservation_id"), F.col("o_custkey").alias("guest_id"), F.upper(F.trim("n_name")).alias("property_code"),
        F.to_date("o_orderdate").alias("stay_date"), F.col("o_orderdate").alias("event_ts"), status.alias("status"), (F.col("o_orderkey") % 3 + 1).cast("long").alias("rooms"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("revenue"), F.col("o_orderkey").alias("source_sequence"), F.col("o_orderpriority").alias("room_type"))


RES = """res AS (
  SELECT o_orderkey AS reservation_id, o_custkey AS guest_id, upper(trim(n_name)) AS property_code, CAST(o_orderdate AS DATE) AS stay_date, o_orderdate AS event_ts,
    CASE o_orderstatus WHEN 'F' THEN 'CHECKED_OUT' WHEN 'O' THEN 'BOOKED' ELSE 'CANCELLED' END AS status, CAST(o_orderkey % 3 + 1 AS BIGINT) AS rooms,
    CAST(o_totalprice AS DECIMAL(18,2)) AS revenue, o_orderkey AS source_sequence, o_orderpriority AS room_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plays of a session (the order) on a device (the supplier, in its nation); rates as they stand, not yet times the coin."""
    l, s, n = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    at = F.expr("l_shipdate + make_dt_interval(0, 0, 0, (l_orderkey * 37 + l_linenumber * 61) % 86400)")
    return l.join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("device"), F.upper(F.trim("n_name")).alias("property_code"), at.alias("event_ts"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("coin_in"), F.col("l_discount").cast("decimal(4,2)").alias("payout_rate"), F.col("l_tax").cast("decimal(4,2)").alias("jackpot_rate"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("game"))


def amounts() -> tuple[Column, Column]:
    """Payout and jackpot of a play: its rates times the coin."""
    return F.col("coin_in") * F.col("payout_rate"), F.col("coin_in") * F.col("jackpot_rate")


def gaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays with their amounts."""
    payout, jackpot = amounts()
    return plays(spark, sf_dir).select("session_id", "device", "property_code", "event_ts", "coin_in", payout.alias("payout"), jackpot.alias("jackpot"), "line", "game")


GAME = """game AS (
  SELECT l_orderkey AS session_id, l_suppkey AS device, upper(trim(n_name)) AS property_code, l_shipdate + to_seconds((l_orderkey * 37 + l_linenumber * 61) % 86400) AS event_ts,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS coin_in, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS payout,
    CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS jackpot, l_linenumber AS line, l_partkey AS game
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions in the app."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("event_ts"), F.col("user_id").alias("guest_id"), F.upper("event_type").alias("action"), F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string")).alias("property_code"), F.col("value").cast("decimal(18,2)").alias("amount"))


MOB = """mob AS (
  SELECT event_id, ts AS event_ts, user_id AS guest_id, upper(event_type) AS action, 'P' || CAST(user_id % 4 AS VARCHAR) AS property_code, CAST(value AS DECIMAL(18,2)) AS amount FROM events)"""


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and sign-ups as reward activity; every tenth has no guest."""
    m = mobile(spark, sf_dir).where(F.col("action").isin("PURCHASE", "SIGNUP"))
    points = F.floor("amount").cast("long") * F.when(F.col("action") == "PURCHASE", 1).otherwise(-1)
    return m.select(F.col("event_id").alias("reward_event_id"), "event_ts", F.when(F.col("event_id") % 10 != 0, F.col("guest_id")).alias("guest_id"), "property_code",
                    F.when(F.col("action") == "PURCHASE", "DINING").otherwise("HOTEL").alias("source_domain"), points.alias("points_delta"), F.col("amount").alias("monetary_value"))


REW = MOB + """, rew AS (
  SELECT event_id AS reward_event_id, event_ts, CASE WHEN event_id % 10 <> 0 THEN guest_id END AS guest_id, property_code, CASE WHEN action = 'PURCHASE' THEN 'DINING' ELSE 'HOTEL' END AS source_domain,
    CAST(floor(amount) AS BIGINT) * CASE WHEN action = 'PURCHASE' THEN 1 ELSE -1 END AS points_delta, amount AS monetary_value
  FROM mob WHERE action IN ('PURCHASE', 'SIGNUP'))"""


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON messages with defects by event id: what the contract queries have to find."""
    i = F.col("event_id")
    none = lambda every, c: F.when(i % every != 0, c)
    other = lambda every, c, bad: F.when(i % every == 0, F.lit(bad)).otherwise(c)
    fields = F.struct(
        none(97, i.cast("string")).alias("event_id"), other(13, F.lit("MOBILE_APP"), "OTHER").alias("event_type"), other(17, F.lit("1"), "9").alias("schema_version"),
        F.lit("APP").alias("source_system"), none(19, F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string"))).alias("property_code"),
        other(23, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "garbage").alias("event_ts"), F.col("user_id").cast("string").alias("guest_token"),
        F.when(i % 29 == 0, F.lit("000-00-0000")).alias("ssn"), F.col("value").cast("string").alias("amount"))
    value = F.when(i % 101 == 0, F.lit('{"event_id": ')).otherwise(F.to_json(fields))
    return read(spark, sf_dir, "events").select(i.alias("n"), F.col("user_id").cast("string").alias("key"), value.alias("value"), F.lit("guest.mobile-events.v1").alias("topic"))


#: The first defect of each message by the stream's order of checks, from the rules above.
RAW_REASON = """CASE WHEN event_id % 101 = 0 OR event_id % 97 = 0 THEN 'MISSING_EVENT_ID' WHEN event_id % 23 = 0 THEN 'MISSING_EVENT_TIME' WHEN event_id % 19 = 0 THEN 'MISSING_REQUIRED_FIELD'
  WHEN event_id % 13 = 0 THEN 'INVALID_EVENT_TYPE' WHEN event_id % 17 = 0 THEN 'UNSUPPORTED_SCHEMA_VERSION' END"""
