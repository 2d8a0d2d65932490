"""Joins, aggregates, marts, ranking, reconciliation, drift and registry queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import scoring
from ..operators import control
from ..operators import relational as R
from ..operators import windows as WIN
from .base import GAME, MOB, RES, REW, dbl, doubles, gaming, mobile, query, read, reservations, rewards, times
from .contract_queries import PATTERN, RISK, WORKLOADS, workloads
from .semantic import METRICS

# --- marts -----------------------------------------------------------------


def performance_5min(plays):
    """Property by windows of five minutes: counts, sums, actual win.

    Plays are summed by session and device first, as the distinct counts make three rows of each row that they read.
    """
    coin, pay, jack = (F.coalesce(F.col(c), F.lit(0)) for c in ("coin_in", "payout", "jackpot"))
    by_play = plays.groupBy(F.to_date("event_ts").alias("event_date"), "property_code", F.window("event_ts", "5 minutes").alias("w"), "session_id", "device").agg(
        F.count("*").alias("event_count"), F.sum(coin).alias("coin_in"), F.sum(pay).alias("payout"), F.sum(jack).alias("jackpot"),
        F.sum(S.net_win(F.col("coin_in"), F.col("payout"), F.col("jackpot"))).alias("actual_win"), F.max("event_ts").alias("source_updated_at"))
    return by_play.groupBy("event_date", "property_code", "w").agg(
        F.sum("event_count").alias("event_count"), F.countDistinct("session_id").alias("gaming_sessions"), F.countDistinct("device").alias("active_devices"),
        *[F.sum(c).alias(c) for c in ("coin_in", "payout", "jackpot", "actual_win")], F.max("source_updated_at").alias("source_updated_at"),
    ).withColumn("window_start", F.col("w.start")).drop("w")


PERF = GAME + """, perf AS (SELECT CAST(event_ts AS DATE) AS event_date, property_code, time_bucket(INTERVAL 5 MINUTE, event_ts) AS window_start, count(*) AS event_count, count(DISTINCT session_id) AS gaming_sessions, count(DISTINCT device) AS active_devices,
  sum(coin_in) AS coin_in, sum(payout) AS payout, sum(jackpot) AS jackpot, sum(coin_in - payout - jackpot) AS actual_win, max(event_ts) AS source_updated_at FROM game GROUP BY 1, 2, 3)"""
PERF_OUT = """event_date, property_code, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event_count, gaming_sessions, active_devices, CAST(coin_in AS DOUBLE) AS coin_in, CAST(payout AS DOUBLE) AS payout, CAST(jackpot AS DOUBLE) AS jackpot,
  CAST(actual_win AS DOUBLE) AS actual_win, strftime(source_updated_at, '%Y-%m-%d %H:%M:%S') AS source_updated_at"""


def shown_performance(df):
    return times(doubles(df, "coin_in", "payout", "jackpot", "actual_win"), "window_start", "source_updated_at")


@query("performance_5min", f"WITH {PERF} SELECT {PERF_OUT} FROM perf")
def performance_5min_query(spark, sf):
    return shown_performance(performance_5min(gaming(spark, sf)))


@query("performance_5min_device", f"WITH {GAME} SELECT property_code, device, strftime(time_bucket(INTERVAL 5 MINUTE, event_ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS event_count, CAST(sum(coin_in - payout - jackpot) AS DOUBLE) AS net_win FROM game GROUP BY 1, 2, 3")
def performance_5min_device(spark, sf):
    out = WIN.tumbling(gaming(spark, sf), "event_ts", "5 minutes", ["property_code", "device"], {"event_count": F.count("*"), "net_win": F.sum(S.net_win(F.col("coin_in"), F.col("payout"), F.col("jackpot")))})
    return times(doubles(out, "net_win"), "window_start").drop("window_end")


def occupancy_daily(rows, inventory):
    """Rooms sold, occupancy, revenue and average rate by property and day. Inventory (property_code, rooms_available) is an input; the rate divides revenue of three states by rooms of two, as the mart defines it."""
    sold, earns = F.col("status").isin("BOOKED", "CHECKED_IN"), F.col("status").isin("BOOKED", "CHECKED_IN", "CHECKED_OUT")
    a = rows.groupBy("property_code", "stay_date").agg(
        F.sum(F.when(sold, F.col("rooms")).otherwise(0)).alias("rooms_sold"), F.sum(F.when(earns, F.col("revenue")).otherwise(F.lit(0).cast("decimal(18,2)"))).alias("room_revenue"), F.max("source_sequence").alias("max_source_sequence"))
    a = a.join(inventory, "property_code", "left")
    return a.withColumns({
        "occupancy_pct": S.safe_divide(100.0 * F.col("rooms_sold"), F.col("rooms_available").cast("double")), "adr": S.safe_divide(dbl("room_revenue"), F.col("rooms_sold").cast("double"))})


INVENTORY = "inv AS (SELECT upper(trim(n_name)) AS property_code, CAST(n_nationkey % 5 AS BIGINT) AS rooms_available FROM nation)"
OCC = f"""{RES}, {INVENTORY}, occ AS (SELECT property_code, stay_date, rooms_available, rooms_sold, room_revenue, max_source_sequence, 100.0 * rooms_sold / nullif(rooms_available, 0)::DOUBLE AS occupancy_pct, CAST(room_revenue AS DOUBLE) / nullif(rooms_sold, 0)::DOUBLE AS adr FROM (
  SELECT property_code, stay_date, CAST(sum(CASE WHEN status IN ('BOOKED', 'CHECKED_IN') THEN rooms ELSE 0 END) AS BIGINT) AS rooms_sold, sum(CASE WHEN status IN ('BOOKED', 'CHECKED_IN', 'CHECKED_OUT') THEN revenue ELSE 0 END) AS room_revenue, max(source_sequence) AS max_source_sequence FROM res GROUP BY 1, 2) LEFT JOIN inv USING (property_code))"""


def inventory(spark, sf):
    return read(spark, sf, "nation").select(F.upper(F.trim("n_name")).alias("property_code"), (F.col("n_nationkey") % 5).cast("long").alias("rooms_available"))


@query("occupancy_daily", f"WITH {OCC} SELECT property_code, stay_date, rooms_available, rooms_sold, CAST(room_revenue AS DOUBLE) AS room_revenue, max_source_sequence, occupancy_pct, adr FROM occ")
def occupancy_daily_query(spark, sf):
    return doubles(occupancy_daily(reservations(spark, sf), inventory(spark, sf)), "room_revenue")


@query("guest_360", f"""WITH {GAME}, {REW}, g AS (SELECT o_custkey AS guest_id, max(event_ts) AS last_gaming_ts, sum(coin_in) AS lifetime_coin_in, sum(coin_in - payout - jackpot) AS lifetime_actual_win, count(DISTINCT session_id) AS gaming_sessions FROM game JOIN orders ON session_id = o_orderkey GROUP BY 1),
  r AS (SELECT guest_id, sum(points_delta) AS points, sum(monetary_value) AS value, max(event_ts) AS last_reward_ts FROM rew WHERE guest_id IS NOT NULL GROUP BY 1)
  SELECT coalesce(g.guest_id, r.guest_id) AS guest_id, strftime(last_gaming_ts, '%Y-%m-%d %H:%M:%S') AS last_gaming_ts, CAST(lifetime_coin_in AS DOUBLE) AS lifetime_coin_in, CAST(lifetime_actual_win AS DOUBLE) AS lifetime_actual_win, gaming_sessions,
  CAST(points AS BIGINT) AS reward_point_delta, CAST(value AS DOUBLE) AS reward_value, strftime(last_reward_ts, '%Y-%m-%d %H:%M:%S') AS last_reward_ts FROM g FULL JOIN r ON g.guest_id = r.guest_id""")
def guest_360(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("guest_id"))
    g = gaming(spark, sf).join(orders, "session_id").groupBy("guest_id").agg(
        F.max("event_ts").alias("last_gaming_ts"), F.sum("coin_in").alias("lifetime_coin_in"), F.sum(S.net_win(F.col("coin_in"), F.col("payout"), F.col("jackpot"))).alias("lifetime_actual_win"), F.countDistinct("session_id").alias("gaming_sessions"))
    r = rewards(spark, sf).where("guest_id is not null").groupBy("guest_id").agg(F.sum("points_delta").alias("reward_point_delta"), F.sum("monetary_value").alias("reward_value"), F.max("event_ts").alias("last_reward_ts"))
    return times(doubles(g.join(r, "guest_id", "full"), "lifetime_coin_in", "lifetime_actual_win", "reward_value"), "last_gaming_ts", "last_reward_ts")


@query("executive_daily", f"""WITH {OCC}, {PERF}, h AS (SELECT stay_date AS business_date, property_code, CAST(sum(rooms_sold) AS BIGINT) AS rooms_sold, sum(room_revenue) AS room_revenue, avg(occupancy_pct) AS occupancy_pct FROM occ GROUP BY 1, 2),
  g AS (SELECT event_date AS business_date, property_code, sum(coin_in) AS coin_in, sum(actual_win) AS gaming_actual_win, CAST(sum(gaming_sessions) AS BIGINT) AS gaming_sessions FROM perf GROUP BY 1, 2)
  SELECT coalesce(h.business_date, g.business_date) AS business_date, coalesce(h.property_code, g.property_code) AS property_code, rooms_sold, CAST(room_revenue AS DOUBLE) AS room_revenue, occupancy_pct, CAST(coin_in AS DOUBLE) AS coin_in, CAST(gaming_actual_win AS DOUBLE) AS gaming_actual_win, gaming_sessions,
  CAST(coalesce(room_revenue, 0) + coalesce(gaming_actual_win, 0) AS DOUBLE) AS measured_operating_revenue FROM h FULL JOIN g ON h.business_date = g.business_date AND h.property_code = g.property_code""")
def executive_daily(spark, sf):
    h = occupancy_daily(reservations(spark, sf), inventory(spark, sf)).groupBy(F.col("stay_date").alias("business_date"), "property_code").agg(F.sum("rooms_sold").alias("rooms_sold"), F.sum("room_revenue").alias("room_revenue"), F.avg("occupancy_pct").alias("occupancy_pct"))
    g = performance_5min(gaming(spark, sf)).groupBy(F.col("event_date").alias("business_date"), "property_code").agg(F.sum("coin_in").alias("coin_in"), F.sum("actual_win").alias("gaming_actual_win"), F.sum("gaming_sessions").alias("gaming_sessions"))
    both = h.join(g, ["business_date", "property_code"], "full")
    both = both.withColumn("measured_operating_revenue", dbl(F.coalesce("room_revenue", F.lit(0)) + F.coalesce("gaming_actual_win", F.lit(0))))
    return doubles(both, "room_revenue", "coin_in", "gaming_actual_win")


@query("incremental_mart", f"WITH {PERF} SELECT {PERF_OUT} FROM perf")
def incremental_mart(spark, sf):
    """The mart built from early plays, then brought up to date window by window; equal to a full build."""
    from ..operators.merge import recompute_windows

    plays = gaming(spark, sf)
    early = plays.where("line % 3 != 0")
    keyed = lambda df: df.withColumns({"event_date": F.to_date("event_ts"), "window_start": S.bucket(F.col("event_ts"), "5 minutes")})
    keys = ["event_date", "property_code", "window_start"]
    return shown_performance(recompute_windows(performance_5min(early), keyed(plays), keyed(plays.where("line % 3 = 0")), keys, performance_5min))


@query("semantic_metrics", f"""WITH {OCC}, {PERF} SELECT o.property_code, o.stay_date, occupancy_pct, adr, win AS gaming_actual_win FROM occ o LEFT JOIN (SELECT property_code, event_date, CAST(sum(actual_win) AS DOUBLE) AS win FROM perf GROUP BY 1, 2) p ON o.property_code = p.property_code AND o.stay_date = p.event_date""")
def semantic_metrics(spark, sf):
    h = occupancy_daily(reservations(spark, sf), inventory(spark, sf)).select("property_code", "stay_date", "rooms_sold", "rooms_available", dbl("room_revenue").alias("room_revenue"))
    g = gaming(spark, sf).groupBy("property_code", F.to_date("event_ts").alias("stay_date")).agg(*[F.sum(c).alias(n) for c, n in (("coin_in", "coin_in"), ("payout", "payout"), ("jackpot", "jackpot_amount"))])
    return h.join(g, ["property_code", "stay_date"], "left").select("property_code", "stay_date", METRICS["occupancy_pct"].column(), METRICS["adr"].column(), dbl(METRICS["gaming_actual_win"].column()).alias("gaming_actual_win"))


# --- joins -------------------------------------------------------------------


@query("stream_static_enrich", f"""WITH {GAME} SELECT property_code, device, strftime(time_bucket(INTERVAL 1 DAY, event_ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS event_count, CAST(sum(coin_in) AS DOUBLE) AS coin_in, any_value(s_name) AS device_name, any_value(s_acctbal > 0) AS active FROM game LEFT JOIN supplier ON device = s_suppkey GROUP BY 1, 2, 3""")
def stream_static_enrich(spark, sf):
    w = WIN.tumbling(gaming(spark, sf), "event_ts", "1 day", ["property_code", "device"], {"event_count": F.count("*"), "coin_in": F.sum("coin_in")})
    ref = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("device"), F.col("s_name").alias("device_name"), (F.col("s_acctbal") > 0).alias("active"))
    return times(doubles(w.join(ref, "device", "left"), "coin_in"), "window_start").drop("window_end")


HOTEL_EVENTS = "h AS (SELECT event_id AS reservation_id, event_ts, guest_id, property_code FROM mob WHERE action = 'PURCHASE'), m AS (SELECT event_id AS mobile_id, event_ts AS mobile_ts, guest_id, property_code, action FROM mob WHERE action <> 'PURCHASE')"


@query("interval_join", f"WITH {MOB}, {HOTEL_EVENTS} SELECT h.guest_id, h.property_code, reservation_id, mobile_id, action FROM h JOIN m ON h.guest_id = m.guest_id AND h.property_code = m.property_code AND mobile_ts BETWEEN event_ts AND event_ts + INTERVAL 10 MINUTE")
def interval_join(spark, sf):
    m = mobile(spark, sf)
    h = m.where("action = 'PURCHASE'").select(F.col("event_id").alias("reservation_id"), "event_ts", "guest_id", "property_code")
    other = m.where("action <> 'PURCHASE'").select(F.col("event_id").alias("mobile_id"), F.col("event_ts").alias("mobile_ts"), "guest_id", "property_code", "action")
    return WIN.interval_join(h, other, ["guest_id", "property_code"], "event_ts", "mobile_ts", "10 MINUTES").select("guest_id", "property_code", "reservation_id", "mobile_id", "action")


@query("interval_join_hot_key", f"WITH {MOB}, {HOTEL_EVENTS} SELECT h.property_code, count(*) AS pairs FROM h JOIN m ON h.property_code = m.property_code AND mobile_ts BETWEEN event_ts AND event_ts + INTERVAL 10 MINUTE GROUP BY 1")
def interval_join_hot_key(spark, sf):
    m = mobile(spark, sf)
    h = m.where("action = 'PURCHASE'").select("event_ts", "property_code")
    other = m.where("action <> 'PURCHASE'").select(F.col("event_ts").alias("mobile_ts"), "property_code")
    return WIN.bucketed_interval_join(h, other, ["property_code"], "event_ts", "mobile_ts", 600).groupBy("property_code").agg(F.count("*").alias("pairs"))


@query("left_profile_join", "SELECT o_orderkey AS reservation_id, c_name AS guest_name, c_mktsegment AS tier FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE o_orderkey > 50 AND o_orderkey <= 4000")
def left_profile_join(spark, sf):
    o = read(spark, sf, "orders").where("o_orderkey > 50 AND o_orderkey <= 4000")
    c = read(spark, sf, "customer").where("c_acctbal > 0")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("reservation_id"), F.col("c_name").alias("guest_name"), F.col("c_mktsegment").alias("tier"))


@query("null_safe_join", f"WITH {REW}, a AS (SELECT guest_id, count(*) AS n FROM rew WHERE source_domain = 'DINING' GROUP BY 1), b AS (SELECT guest_id, count(*) AS n FROM rew WHERE source_domain = 'HOTEL' GROUP BY 1) SELECT a.guest_id, a.n AS dining, b.n AS hotel FROM a JOIN b ON a.guest_id IS NOT DISTINCT FROM b.guest_id")
def null_safe_join(spark, sf):
    r = rewards(spark, sf).groupBy("guest_id", "source_domain").agg(F.count("*").alias("n"))
    a, b = r.where("source_domain = 'DINING'").alias("a"), r.where("source_domain = 'HOTEL'").alias("b")
    return a.join(b, F.col("a.guest_id").eqNullSafe(F.col("b.guest_id"))).select("a.guest_id", F.col("a.n").alias("dining"), F.col("b.n").alias("hotel"))


@query("enqueue_antijoin", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.event_id AND o_orderkey % 2 = 0) AND event_id % 3 <> 0")
def enqueue_antijoin(spark, sf):
    from ..operators.merge import enqueue

    e = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("{")).otherwise(F.col("props")).alias("payload"))
    outbox = read(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"))
    return enqueue(outbox, e).select("event_id")


#: The domains and specialisations of the agent registry.
AGENT_DOMAINS = ("Data Platform", "Hotel", "Gaming", "Loyalty", "Digital Product", "Marketing", "Finance", "Revenue Management", "Property Operations", "Security", "Compliance", "Data Science", "SRE", "Executive Analytics")
AGENT_SPECIALISATIONS = ("Sentinel", "Forecaster", "Optimizer", "Reconciler", "Contract Guardian", "Incident Analyst", "Capacity Planner", "Portfolio Advisor")


def _values(names, column):
    return f"(VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in names)}) AS {column[0]}({column})"


@query("agent_registry", f"SELECT replace(lower(domain || '-' || specialisation), ' ', '-') AS agent_id, domain, specialisation, 'Provide evidence-backed ' || lower(specialisation) || ' recommendations for ' || domain || '.' AS objective FROM {_values(AGENT_DOMAINS, 'domain')} CROSS JOIN {_values(AGENT_SPECIALISATIONS, 'specialisation')}")
def agent_registry(spark, sf):
    """Every domain with every specialisation: two constant lists, 112 rows."""
    rows = spark.createDataFrame(list(product(AGENT_DOMAINS, AGENT_SPECIALISATIONS)), "domain string, specialisation string")
    text = F.concat(F.lit("Provide evidence-backed "), F.lower("specialisation"), F.lit(" recommendations for "), "domain", F.lit("."))
    return rows.select(S.slug(F.col("domain"), F.col("specialisation")).alias("agent_id"), "domain", "specialisation", text.alias("objective"))


@query("platform_counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM customer) AS customer, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors")
def platform_counts(spark, sf):
    out = None
    for name in ("orders", "lineitem", "customer", "events"):
        one = read(spark, sf, name).agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.crossJoin(read(spark, sf, "events").where("event_type = 'error'").agg(F.count("*").alias("errors")))


@query("incremental_scalar", "SELECT event_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup') - INTERVAL 15 MINUTE")
def incremental_scalar(spark, sf):
    e = read(spark, sf, "events")
    e.createOrReplaceTempView("millrace_events")
    return spark.sql("SELECT event_id, event_type FROM millrace_events WHERE ts > (SELECT coalesce(max(ts), TIMESTAMP_NTZ '1900-01-01') FROM millrace_events WHERE event_type = 'signup') - INTERVAL 15 MINUTES")


DEPS = "d AS (SELECT p_partkey AS id, [p_partkey // 2, p_partkey // 3] AS needs, CASE WHEN p_partkey % 4 = 0 THEN 'RUNNING' ELSE 'COMPLETE' END AS status FROM part WHERE p_partkey > 0)"


@query("deps_complete", f"WITH {DEPS}, e AS (SELECT id, unnest(needs) AS needed FROM d) SELECT id, status, NOT EXISTS (SELECT 1 FROM e WHERE e.id = d.id AND NOT EXISTS (SELECT 1 FROM d x WHERE x.id = e.needed AND x.status = 'COMPLETE')) AS ready FROM d")
def deps_complete(spark, sf):
    k = F.col("p_partkey")
    d = read(spark, sf, "part").where("p_partkey > 0").select(k.alias("id"), F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long")).alias("needs"), F.when(k % 4 == 0, "RUNNING").otherwise("COMPLETE").alias("status"))
    return R.dependencies_complete(d, "id", "needs", "status").select("id", "status", "ready")


# --- aggregates ----------------------------------------------------------------


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return R.duplicate_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("sequence_gaps", f"WITH {RES} SELECT property_code, max(source_sequence) - min(source_sequence) + 1 - count(DISTINCT source_sequence) AS estimated_gap FROM res GROUP BY 1")
def sequence_gaps(spark, sf):
    return R.sequence_gaps(reservations(spark, sf), ["property_code"], "source_sequence")


@query("profile_status", f"WITH {RES} SELECT property_code, status, count(*) AS row_count, CAST(sum(revenue) AS DOUBLE) AS revenue, min(stay_date) AS first_stay, max(stay_date) AS last_stay FROM res GROUP BY 1, 2")
def profile_status(spark, sf):
    return R.profile(reservations(spark, sf), ["property_code", "status"], {"revenue": dbl(F.sum("revenue")), "first_stay": F.min("stay_date"), "last_stay": F.max("stay_date")})


@query("profile_rewards", f"WITH {REW} SELECT property_code, source_domain, count(*) AS row_count, CAST(sum(points_delta) AS BIGINT) AS points, CAST(sum(monetary_value) AS DOUBLE) AS value FROM rew GROUP BY 1, 2")
def profile_rewards(spark, sf):
    return R.profile(rewards(spark, sf), ["property_code", "source_domain"], {"points": F.sum("points_delta"), "value": dbl(F.sum("monetary_value"))})


@query("profile_payments", "SELECT c_mktsegment AS method, c_nationkey % 3 AS channel, c_acctbal < 0 AS is_refund, count(*) AS row_count, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM customer GROUP BY 1, 2, 3")
def profile_payments(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("method"), (F.col("c_nationkey") % 3).alias("channel"), (F.col("c_acctbal") < 0).alias("is_refund"), F.col("c_acctbal").cast("decimal(18,2)").alias("a"))
    return R.profile(c, ["method", "channel", "is_refund"], {"amount": dbl(F.sum("a"))})


@query("profile_operations", "SELECT l_returnflag AS category, l_linestatus AS state, count(*) AS row_count, min(CAST(l_shipdate AS DATE)) AS opened_first, max(CAST(l_shipdate AS DATE)) AS opened_last FROM lineitem GROUP BY 1, 2")
def profile_operations(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("state"), F.to_date("l_shipdate").alias("d"))
    return R.profile(l, ["category", "state"], {"opened_first": F.min("d"), "opened_last": F.max("d")})


@query("platform_health", """WITH r AS (SELECT event_type AS pipeline, event_id % 50 = 0 AND event_type IN ('error', 'view') AS failed, event_id AS source_rows, event_id % 97 AS quarantined FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-25 00:00:00')
  SELECT pipeline, count(*) AS run_count, count(*) FILTER (WHERE failed) AS failures, CAST(sum(source_rows) AS BIGINT) AS source_rows, CAST(sum(quarantined) AS BIGINT) AS quarantined_rows, 100.0::DOUBLE * count(*) FILTER (WHERE failed) / count(*) AS failure_pct,
  CASE WHEN count(*) FILTER (WHERE failed) > 0 THEN 'ALERT' WHEN sum(quarantined) > sum(source_rows) * 0.01 THEN 'WARN' ELSE 'HEALTHY' END AS health_status FROM r GROUP BY 1""")
def platform_health(spark, sf):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    e = read(spark, sf, "events").where(F.col("ts").between(now - F.expr("INTERVAL 24 HOURS"), now))
    failed = (F.col("event_id") % 50 == 0) & F.col("event_type").isin("error", "view")
    a = e.groupBy(F.col("event_type").alias("pipeline")).agg(F.count("*").alias("run_count"), F.count_if(failed).alias("failures"), F.sum("event_id").alias("source_rows"), F.sum(F.col("event_id") % 97).alias("quarantined_rows"))
    status = F.when(F.col("failures") > 0, "ALERT").when(F.col("quarantined_rows") > F.col("source_rows") * 0.01, "WARN").otherwise("HEALTHY")
    return a.withColumns({"failure_pct": S.safe_divide(100.0 * F.col("failures"), F.col("run_count").cast("double")), "health_status": status})


@query("latest_event", f"WITH {MOB} SELECT strftime(time_bucket(INTERVAL 1 DAY, event_ts), '%Y-%m-%d %H:%M:%S') AS window_start, guest_id, arg_max(event_id, event_ts) AS event_id, arg_max(action, event_ts) AS action FROM mob GROUP BY 1, 2")
def latest_event(spark, sf):
    return times(WIN.latest_per_window(mobile(spark, sf), "event_ts", "1 day", ["guest_id"], "event_id").select("window_start", "guest_id", "event_id", "action"), "window_start")


@query("reconcile", f"WITH {RES} SELECT (SELECT count(*) FROM orders) AS source_count, CAST((SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS DOUBLE) AS source_amount, (SELECT count(*) FROM res WHERE status <> 'CANCELLED') AS target_count, CAST((SELECT sum(revenue) FROM res WHERE status <> 'CANCELLED') AS DOUBLE) AS target_amount, (SELECT count(*) FROM orders) - (SELECT count(*) FROM res WHERE status <> 'CANCELLED') - 3 AS unexplained_count_delta, false AS balanced")
def reconcile(spark, sf):
    source = read(spark, sf, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("revenue"))
    out = R.reconcile(source, reservations(spark, sf).where("status <> 'CANCELLED'"), "revenue", explained_count=3)
    return doubles(out.drop("unexplained_amount_delta"), "source_amount", "target_amount")


@query("outcome_balance", "SELECT count(*) AS source, count(*) FILTER (WHERE event_type = 'view') AS applied, count(*) FILTER (WHERE event_type = 'click') AS duplicate, count(*) FILTER (WHERE event_type = 'signup') AS stale, count(*) FILTER (WHERE event_type IN ('error')) AS quarantine, count(*) FILTER (WHERE event_type = 'purchase') AS unexplained FROM events")
def outcome_balance(spark, sf):
    names = {"view": "applied", "click": "duplicate", "signup": "stale", "error": "quarantine"}
    label = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("none"))
    return R.outcome_balance(read(spark, sf, "events").select(label.alias("outcome")), "outcome", names.values())


_PIECES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query("order_free_checksum", f"WITH t AS (SELECT md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus) AS h FROM orders) SELECT count(*) AS row_count, concat_ws('-', {_PIECES}) AS checksum FROM t")
def order_free_checksum(spark, sf):
    return R.checksum(read(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("psi_drift", """WITH r AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT l_extendedprice * 1.1 AS x FROM lineitem WHERE l_orderkey % 2 = 1), e AS (SELECT unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM r), b AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
  h AS (SELECT side, bin, count(*) AS n FROM (SELECT 0 AS side, (SELECT count(*) FROM e WHERE edge <= x) AS bin FROM r UNION ALL SELECT 1, (SELECT count(*) FROM e WHERE edge <= x) FROM c, b WHERE x BETWEEN lo AND hi) GROUP BY 1, 2),
  p AS (SELECT bins.bin, greatest(coalesce(max(n) FILTER (WHERE side = 0), 0) / (SELECT sum(n) FROM h WHERE side = 0), 1e-6) AS r, greatest(coalesce(max(n) FILTER (WHERE side = 1), 0) / (SELECT sum(n) FROM h WHERE side = 1), 1e-6) AS c FROM range(10) AS bins(bin) LEFT JOIN h ON h.bin = bins.bin GROUP BY 1)
  SELECT round(sum((c - r) * ln(c / r)), 9) AS psi, CASE WHEN sum((c - r) * ln(c / r)) < 0.10 THEN 'PASS' WHEN sum((c - r) * ln(c / r)) < 0.25 THEN 'REVIEW' ELSE 'BLOCK' END AS class FROM p""")
def psi_drift(spark, sf):
    l = read(spark, sf, "lineitem")
    out = R.psi(l.where("l_orderkey % 2 = 0").select(F.col("l_extendedprice").alias("x")), l.where("l_orderkey % 2 = 1").select((F.col("l_extendedprice") * 1.1).alias("x")), "x")
    return out.select(F.round("psi", 9).alias("psi"), scoring.drift_class(F.col("psi")).alias("class"))


@query("time_split", "WITH c AS (SELECT quantile_cont(epoch(o_orderdate), 0.8) AS cut FROM orders) SELECT CASE WHEN epoch(o_orderdate) <= cut THEN 'train' ELSE 'test' END AS part, count(*) AS n_rows FROM orders, c GROUP BY 1")
def time_split(spark, sf):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    o = read(spark, sf, "orders").select(seconds.alias("s"))
    cut = R.percentiles(o, "s", [0.8])
    return o.groupBy(F.when(F.col("s") <= (cut[0] if cut else 0.0), "train").otherwise("test").alias("part")).agg(F.count("*").alias("n_rows"))


@query("exclusive_p95", "WITH o AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS m FROM lineitem), k AS (SELECT any_value(95 * (m + 1) // 100) AS j, any_value(95 * (m + 1) % 100) AS d FROM o) SELECT round(sum(CASE WHEN r = j THEN x * (100 - d) ELSE x * d END) / 100, 6) AS p95 FROM o, k WHERE r IN (j, j + 1)")
def exclusive_p95(spark, sf):
    return R.exclusive_quantile(read(spark, sf, "lineitem"), "l_extendedprice", 95, 100).select(F.round("quantile", 6).alias("p95"))


# --- ranking -------------------------------------------------------------------


@query("latest_rows", "SELECT l_orderkey, l_linenumber, l_shipdate_text, l_partkey FROM (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_text, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1")
def latest_rows(spark, sf):
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate_text"), "l_partkey")
    return R.latest_by(l, ["l_orderkey"], ["l_linenumber", "l_shipdate_text", "l_partkey"])


@query("latest_batch", "SELECT query_name, batch_id, health_status FROM (SELECT event_type AS query_name, event_id AS batch_id, CASE WHEN event_id % 11 = 0 THEN 'RED' WHEN value > 100 THEN 'AMBER' WHEN user_id < 10 THEN 'AMBER' ELSE 'GREEN' END AS health_status, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_batch(spark, sf):
    from ..streaming.health import health_status

    e = read(spark, sf, "events").withColumnsRenamed({"event_type": "query_name", "event_id": "batch_id"})
    last = R.latest(e, ["query_name"], [F.col("batch_id").desc()])
    status = health_status(F.when(F.col("batch_id") % 11 == 0, "FAILED").otherwise("OK"), F.col("value") * 1200, F.when(F.col("user_id") < 10, 0.0).otherwise(10.0), F.lit(10.0))
    return last.select("query_name", "batch_id", status.alias("health_status"))


@query("last_two", "SELECT o_custkey, o_orderkey, recency FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency FROM orders) WHERE recency <= 2")
def last_two(spark, sf):
    return R.last_n(read(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 2).select("o_custkey", "o_orderkey", "recency")


@query("claim_topk", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') ORDER BY event_id LIMIT 100")
def claim_topk(spark, sf):
    e = read(spark, sf, "events").where(F.col("event_type").isin("error", "signup"))
    return R.top_k(e, [F.col("event_id")], 100).select("event_id", "event_type")


@query("property_distribution", f"WITH {RES} SELECT property_code, count(*) AS n_rows FROM res GROUP BY 1 ORDER BY 2 DESC, 1")
def property_distribution(spark, sf):
    return reservations(spark, sf).groupBy("property_code").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "property_code")


# --- migration -------------------------------------------------------------------


@query("cutover_gate", """WITH h AS (SELECT o_custkey AS workload, o_orderkey % 3 <> 0 AS ready, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders), v AS (SELECT workload, count(*) AS n, bool_and(ready) FILTER (WHERE r <= 2) AS both_ready FROM h GROUP BY 1)
  SELECT workload, concat_ws(',', CASE WHEN n < 2 THEN 'TWO_VALIDATIONS_REQUIRED' WHEN NOT both_ready THEN 'RECENT_VALIDATION_FAILED' END, CASE WHEN workload % 4 = 0 THEN 'ROLLBACK_CHECKPOINT_REQUIRED' END) AS reasons, n >= 2 AND both_ready AND workload % 4 <> 0 AS approved FROM v""")
def cutover_gate(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("workload"), F.lit("VALIDATED").alias("event"), (F.col("o_orderkey") % 3 != 0).alias("ready"), F.lit(None).cast("map<string,string>").alias("note"))
    points = o.where("workload % 4 <> 0").withColumns({"event": F.lit("CHECKPOINT"), "ready": F.lit(None).cast("boolean"), "note": F.create_map(F.lit("route"), F.lit("old"))})
    decided = control.cutover_decision(control.migration_state(o.unionByName(points)))
    return decided.select("workload", F.array_join("reasons", ",").alias("reasons"), "approved")


@query("migration_summary", f"WITH {WORKLOADS}, e AS (SELECT l_partkey AS workload_id, count(*) AS evidence_count FROM lineitem GROUP BY 1) SELECT workload_id, {RISK} AS risk_score, {PATTERN} AS pattern, coalesce(evidence_count, 0) AS evidence_count FROM w LEFT JOIN e USING (workload_id) ORDER BY risk_score DESC, workload_id")
def migration_summary(spark, sf):
    c = F.col
    e = read(spark, sf, "lineitem").groupBy(c("l_partkey").alias("workload_id")).agg(F.count("*").alias("evidence_count"))
    w = workloads(spark, sf).join(e, "workload_id", "left")
    return w.select("workload_id", scoring.risk_score(c("criticality"), c("pii"), c("daily_rows"), c("sla_minutes"), c("deps")).cast("long").alias("risk_score"), scoring.migration_pattern(c("sla_minutes"), c("daily_rows"), c("platform")).alias("pattern"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count")).orderBy(F.desc("risk_score"), "workload_id")


@query("cutover_checklist", "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 9 = 0 THEN 19 ELSE 20 END AS passed, o_orderkey % 9 <> 0 AS all_passed FROM orders")
def cutover_checklist(spark, sf):
    each = read(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.explode(F.array(*[F.lit(c) for c in control.CUTOVER_CHECKS])).alias("check"))
    results = each.withColumn("done", (F.col("check") != "checksums_match") | (F.col("run") % 9 != 0))
    return control.checklist(results).drop("missing")


@query("dbt_tests", "SELECT 'not_null_guest' AS test, count(*) FILTER (WHERE event_id % 10 = 0) AS violations FROM events WHERE event_type IN ('purchase', 'signup') UNION ALL SELECT 'unique_order', 0 UNION ALL SELECT 'unique_order_in_lines', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))")
def dbt_tests(spark, sf):
    tests = {"not_null_guest": R.not_null_violations(rewards(spark, sf), "guest_id"), "unique_order": R.unique_violations(read(spark, sf, "orders"), "o_orderkey"), "unique_order_in_lines": R.unique_violations(read(spark, sf, "lineitem"), "l_orderkey")}
    out = None
    for name, df in tests.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("test"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query("freshness_slo", "SELECT event_type, count(*) AS events, count(*) FILTER (WHERE value <= 120) AS in_time, CAST(count(*) FILTER (WHERE value <= 120) AS DOUBLE) / count(*) AS sli, CAST(count(*) FILTER (WHERE value <= 120) AS DOUBLE) / count(*) >= 0.995 AS met, (1 - CAST(count(*) FILTER (WHERE value <= 120) AS DOUBLE) / count(*)) / (1 - 0.995::DOUBLE) AS burn_rate FROM events GROUP BY 1")
def freshness_slo(spark, sf):
    from .semantic import SLOS

    slo = SLOS["gaming_event_freshness"]
    e = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("value") <= 120).alias("in_time"))
    sli = F.col("in_time").cast("double") / F.col("events")
    return e.withColumn("sli", sli).withColumn("met", F.col("sli") >= slo.objective).withColumn("burn_rate", slo.burn_rate(F.col("sli")))

