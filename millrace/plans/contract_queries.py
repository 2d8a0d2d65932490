"""Queries of sources, contracts, routing and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import scoring
from ..operators import contracts as C
from ..operators import relational as R
from ..sources import readers
from .base import GAME, MOB, RAW_REASON, RES, REW, dbl, gaming, mobile, query, raw_messages, read, reservations, rewards, text_ts, times

AS_OF = "2001-08-01 00:00:00"

RESERVATION_EXTRACT = readers.ExtractSpec(
    {"reservation_id": "o_orderkey", "guest_id": "o_custkey", "status": "o_orderstatus", "revenue": "CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS DOUBLE)", "updated": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')"},
    "o_orderkey", key="o_orderkey", event_ts="o_orderdate")


@query("extract_reservations", f"""SELECT o_orderkey AS reservation_id, o_custkey AS guest_id, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS DOUBLE) AS revenue,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated, CAST(o_orderkey AS VARCHAR) AS source_business_key, o_orderkey AS source_watermark
  FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 5000 AND o_orderdate < TIMESTAMP '{AS_OF}' + INTERVAL 5 MINUTE""")
def extract_reservations(spark, sf):
    return readers.bounded_extract(read(spark, sf, "orders"), RESERVATION_EXTRACT, 100, 5000, F.lit(AS_OF).cast("timestamp_ntz"), ordered=True)


@query("extract_gaming", """SELECT l_orderkey AS session_id, l_suppkey AS device, CAST(CAST(l_extendedprice AS DECIMAL(19,2)) AS DOUBLE) AS coin_in, CAST(l_orderkey AS VARCHAR) AS source_business_key, l_orderkey AS source_watermark
  FROM lineitem WHERE l_orderkey > 1000 AND l_orderkey <= 9000 AND l_quantity >= 10""")
def extract_gaming(spark, sf):
    spec = readers.ExtractSpec({"session_id": "l_orderkey", "device": "l_suppkey", "coin_in": "CAST(CAST(l_extendedprice AS DECIMAL(19,2)) AS DOUBLE)"}, "l_orderkey", key="l_orderkey", predicates=("l_quantity >= 10",))
    return readers.bounded_extract(read(spark, sf, "lineitem"), spec, 1000, 9000)


@query("extract_rewards", """SELECT event_id AS reward_event_id, user_id AS guest_id, CAST(event_id AS VARCHAR) AS source_business_key, event_id AS source_watermark FROM events WHERE event_id > 10 AND event_id <= 4000 AND event_type = 'purchase'""")
def extract_rewards(spark, sf):
    spec = readers.ExtractSpec({"reward_event_id": "event_id", "guest_id": "user_id"}, "event_id", key="event_id", predicates=("event_type = 'purchase'",))
    return readers.bounded_extract(read(spark, sf, "events"), spec, 10, 4000)


@query("extract_payment", """SELECT 'P' || CAST(o_custkey % 4 AS VARCHAR) AS property_code, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS business_ts, CASE WHEN o_orderkey % 9 = 0 THEN 'REFUND' ELSE 'CHARGE' END AS payment_type,
  CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS DOUBLE) AS amount, 'USD' AS currency, o_orderstatus AS status, CAST(o_orderkey AS VARCHAR) AS source_business_key, o_orderkey AS source_watermark FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 5000""")
def extract_payment(spark, sf):
    columns = {"property_code": "'P' || CAST(o_custkey % 4 AS STRING)", "business_ts": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')", "payment_type": "IF(o_orderkey % 9 = 0, 'REFUND', 'CHARGE')",
               "amount": "CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS DOUBLE)", "currency": "'USD'", "status": "o_orderstatus"}
    return readers.bounded_extract(read(spark, sf, "orders"), readers.ExtractSpec(columns, "o_orderkey", key="o_orderkey"), 100, 5000)


@query("extract_work_order", """SELECT 'P' || CAST(user_id % 4 AS VARCHAR) AS property_code, 'Z' || CAST(user_id % 7 AS VARCHAR) AS zone_code, strftime(ts, '%Y-%m-%d %H:%M:%S') AS open_ts,
  CASE WHEN event_id % 5 <> 0 THEN strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') END AS close_ts, CASE WHEN event_id % 3 = 0 THEN 'CRITICAL' ELSE 'NORMAL' END AS priority,
  CASE WHEN event_id % 5 <> 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, event_type AS category, CAST(event_id AS VARCHAR) AS source_business_key, event_id AS source_watermark FROM events WHERE event_id > 10 AND event_id <= 4000""")
def extract_work_order(spark, sf):
    columns = {"property_code": "'P' || CAST(user_id % 4 AS STRING)", "zone_code": "'Z' || CAST(user_id % 7 AS STRING)", "open_ts": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
               "close_ts": "IF(event_id % 5 <> 0, date_format(ts + INTERVAL 30 MINUTES, 'yyyy-MM-dd HH:mm:ss'), NULL)", "priority": "IF(event_id % 3 = 0, 'CRITICAL', 'NORMAL')",
               "status": "IF(event_id % 5 <> 0, 'CLOSED', 'OPEN')", "category": "event_type"}
    return readers.bounded_extract(read(spark, sf, "events"), readers.ExtractSpec(columns, "event_id", key="event_id"), 10, 4000)


@query("high_watermark", "SELECT 'orders' AS source, coalesce(max(o_orderkey), 0) AS high_watermark FROM orders UNION ALL SELECT 'events', coalesce(max(event_id), 0) FROM events UNION ALL SELECT 'none', 0")
def high_watermark(spark, sf):
    orders, events = read(spark, sf, "orders"), read(spark, sf, "events")
    parts = [readers.high_watermark(d, c).select(F.lit(n).alias("source"), F.col("high_watermark").cast("long").alias("high_watermark")) for n, d, c in (("orders", orders, "o_orderkey"), ("events", events, "event_id"), ("none", events.where("false"), "event_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("source_freshness", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_loaded_at, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-01-31 06:00:00') AS age_seconds, CASE WHEN date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-01-31 06:00:00') > 86400 THEN 'error' WHEN date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-01-31 06:00:00') > 600 THEN 'warn' ELSE 'pass' END AS status FROM events")
def source_freshness(spark, sf):
    e = read(spark, sf, "events").select(F.date_trunc("second", "ts").alias("ts"))
    return times(readers.freshness(e, "ts", F.lit("2024-01-31 06:00:00").cast("timestamp_ntz"), 600, 86400), "max_loaded_at")


@query("control_lookup", "WITH runs AS (SELECT event_type AS pipeline, event_id AS high, CASE WHEN event_id % 7 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM events) SELECT pipeline, max(high) AS low_watermark FROM runs WHERE status = 'SUCCEEDED' GROUP BY 1")
def control_lookup(spark, sf):
    runs = read(spark, sf, "events").select(F.col("event_type").alias("pipeline"), F.col("event_id").alias("high"), F.when(F.col("event_id") % 7 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"))
    return runs.where("status = 'SUCCEEDED'").groupBy("pipeline").agg(F.max("high").alias("low_watermark"))


@query("push_decode", """SELECT event_id AS n, CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS message_id, CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'no json' ELSE props END AS payload,
  CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN 'INVALID_DATA' WHEN event_id % 41 = 0 THEN 'INVALID_JSON' END AS decode_error, CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_type END AS topic FROM events""")
def push_decode(spark, sf):
    i, e = F.col("event_id"), read(spark, sf, "events")
    data = F.when(i % 37 == 0, F.lit("***")).otherwise(F.base64(F.when(i % 41 == 0, F.lit("no json")).otherwise(F.col("props")).cast("binary")))
    body = F.to_json(F.struct(F.struct(data.alias("data"), i.cast("string").alias("messageId"), F.create_map(F.lit("topic"), F.col("event_type")).alias("attributes")).alias("message")))
    pushed = e.select(i.alias("n"), F.when(i % 31 == 0, F.lit("{broken")).otherwise(body).alias("body"))
    return readers.decode_push(pushed).select("n", "message_id", F.col("attributes")["topic"].alias("topic"), "payload", "decode_error")


MOBILE = C.StreamContract("mobile", "MOBILE_APP", ("event_id", "event_type", "schema_version", "property_code"), ("guest_token",), extra={"amount": "string"})


@query("source_metadata", "SELECT CAST(user_id AS VARCHAR) AS _source_key, 'guest.mobile-events.v1' AS _source_topic, count(*) AS messages FROM events GROUP BY 1, 2")
def source_metadata(spark, sf):
    return readers.add_source_metadata(raw_messages(spark, sf)).groupBy("_source_key", "_source_topic").agg(F.count("*").alias("messages"))


@query("envelope_parse", f"""SELECT event_id AS n, CASE WHEN event_id % 101 = 0 OR event_id % 97 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'OTHER' ELSE 'MOBILE_APP' END AS event_type,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS guest_token, CASE WHEN event_id % 101 = 0 OR event_id % 19 = 0 THEN NULL ELSE 'P' || CAST(user_id % 4 AS VARCHAR) END AS property_code FROM events""")
def envelope_parse(spark, sf):
    return C.parse_envelope(raw_messages(spark, sf), MOBILE).select("n", "event_id", "event_type", "guest_token", "property_code")


@query("dq_status", f"SELECT event_id AS n, {RAW_REASON} IS NULL AS _dq_valid, {RAW_REASON} AS _dq_reason FROM events")
def dq_status(spark, sf):
    return C.add_quality_status(C.parse_envelope(raw_messages(spark, sf), MOBILE), MOBILE).select("n", "_dq_valid", "_dq_reason")


@query("quarantine_split", f"SELECT CASE WHEN reason IS NULL THEN 'clean' ELSE 'quarantine' END AS zone, coalesce(reason, 'NONE') AS reason, count(*) AS events FROM (SELECT {RAW_REASON} AS reason FROM events) GROUP BY 1, 2")
def quarantine_split(spark, sf):
    checked = C.parse_envelope(raw_messages(spark, sf), MOBILE).withColumn("reason", C.first_reason(C.quality_checks(MOBILE)))
    clean, bad = C.split(checked, "reason")
    zone = lambda df, z, r: df.groupBy(F.lit(z).alias("zone"), r.alias("reason")).agg(F.count("*").alias("events"))
    return zone(clean, "clean", F.lit("NONE")).unionByName(zone(bad, "quarantine", F.col("reason")))


@query("message_validate", """SELECT event_id AS n, CASE WHEN event_id % 101 = 0 THEN 'INVALID_JSON' WHEN event_id % 97 = 0 THEN 'MISSING_EVENT_ID' WHEN event_id % 19 = 0 THEN 'MISSING_PROPERTY_CODE' WHEN event_id % 13 = 0 THEN 'INVALID_EVENT_TYPE'
  WHEN event_id % 17 = 0 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN event_id % 23 = 0 THEN 'INVALID_EVENT_TIME' WHEN event_id % 29 = 0 THEN 'PLAINTEXT_SENSITIVE_IDENTIFIER' END AS reason FROM events""")
def message_validate(spark, sf):
    text = raw_messages(spark, sf)
    payload = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", "MAP<STRING, STRING>"))
    return text.withColumn("payload", payload).select("n", C.first_reason(C.message_checks("guest_token", "MOBILE_APP")).alias("reason"))


def _reservation_payloads(spark, sf):
    """Orders as reservation events in maps of text, with defects by order key."""
    i = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    payload = F.create_map(
        F.lit("reservation_id"), F.when(i % 11 == 0, F.lit(" ")).otherwise(text(i)), F.lit("arrival_date"), text(F.to_date("o_orderdate")),
        F.lit("departure_date"), F.when(i % 7 == 0, text(F.date_sub("o_orderdate", 1))).when(i % 29 != 0, text(F.date_add("o_orderdate", 2))),
        F.lit("rooms"), F.when(i % 13 == 0, F.lit("-1")).otherwise(F.lit("2")), F.lit("revenue_amount"), F.when(i % 17 == 0, F.lit("-5.00")).otherwise(text(F.col("o_totalprice").cast("decimal(18,2)"))))
    return read(spark, sf, "orders").select(
        text(i).alias("event_id"), F.lit("hotel_reservation").alias("event_type"), F.when(i % 19 != 0, F.lit("CORE")).alias("source_system"), F.concat(F.lit("P"), text(i % 5)).alias("property_code"),
        F.col("o_orderdate").alias("event_time"), F.when(i % 23 == 0, F.lit("7")).otherwise(F.lit("1")).alias("schema_version"), payload.alias("payload"), i.alias("n"))


@query("dq_reasons_all", """WITH f AS (SELECT o_orderkey AS n, list_sort(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'RESERVATION_ID_REQUIRED' END, CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 7 <> 0 THEN 'STAY_DATES_REQUIRED' END, CASE WHEN o_orderkey % 7 = 0 THEN 'DEPARTURE_BEFORE_ARRIVAL' END,
    CASE WHEN o_orderkey % 13 = 0 THEN 'ROOMS_NEGATIVE' END, CASE WHEN o_orderkey % 17 = 0 THEN 'REVENUE_NEGATIVE' END, CASE WHEN o_orderkey % 19 = 0 THEN 'SOURCE_SYSTEM_REQUIRED' END, CASE WHEN o_orderkey % 23 = 0 THEN 'UNSUPPORTED_SCHEMA_VERSION' END,
    CASE WHEN o_orderkey % 5 = 4 THEN 'PROPERTY_UNSUPPORTED' END, CASE WHEN o_orderdate > TIMESTAMP '2001-01-01 00:05:00' THEN 'FUTURE_EVENT_TIME' END], lambda x: x IS NOT NULL)) AS r FROM orders)
  SELECT n, array_to_string(r, ',') AS reasons, CASE WHEN len(r) > 0 THEN 'quarantine' ELSE 'clean' END AS zone FROM f""")
def dq_reasons_all(spark, sf):
    routed = C.route(_reservation_payloads(spark, sf), ("P0", "P1", "P2", "P3"), ("1", "2"), F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))
    return routed.select("n", F.array_join("reasons", ",").alias("reasons"), "zone")


@query("quality_rules", """WITH v AS (SELECT event_id AS n, list_filter([CASE WHEN event_id % 6 = 0 THEN 'required:guest' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'allowed:action' END, CASE WHEN event_id % 9 = 0 THEN 'non_negative:amount' END, CASE WHEN event_id % 14 = 0 THEN 'sensitive_data_tokenization' END,
    CASE WHEN value > 100 THEN 'large' END], lambda x: x IS NOT NULL) AS r FROM events) SELECT n, array_to_string(r, ',') AS failed, len(list_filter(r, lambda x: x <> 'large')) = 0 AS valid FROM v""")
def quality_rules(spark, sf):
    i = F.col("event_id")
    e = read(spark, sf, "events").select(
        i.alias("n"), F.when(i % 6 == 0, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("guest"), F.col("event_type").alias("action"), F.when(i % 18 == 0, F.lit("abc")).when(i % 9 == 0, F.lit("-1")).otherwise(F.col("value").cast("string")).alias("amount"),
        F.create_map(F.lit("SSN"), F.when(i % 14 == 0, F.lit("1")).otherwise(F.lit("")), F.lit("k"), F.col("props")).alias("payload"), "value")
    rules = [C.required("guest"), C.allowed("action", ("CLICK", "VIEW", "PURCHASE")), C.non_negative("amount"), C.no_plaintext_sensitive_fields("payload"), C.predicate("large", F.col("value") <= 100, "WARN")]
    return C.evaluate(e, rules).select("n", F.array_join(F.col("violations.rule"), ",").alias("failed"), "valid")


#: A contract in JSON Schema as the compiler takes it.
SLOT_SCHEMA = {
    "additionalProperties": False, "required": ["event_id", "event_type", "coin_in"],
    "properties": {"event_id": {"type": "string", "minLength": 2}, "event_type": {"const": "SLOT_PLAY"}, "coin_in": {"type": "number", "minimum": 0}, "status": {"enum": ["F", "O"]}, "line": {"type": "integer"}, "day": {"type": "string", "format": "date"}},
}


@query("contract_check", """WITH f AS (SELECT o_orderkey AS n, list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'REQUIRED_COIN_IN' END, CASE WHEN o_orderkey < 10 THEN 'LENGTH_EVENT_ID' END, CASE WHEN o_orderkey % 6 = 0 THEN 'CONST_EVENT_TYPE' END,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 'MINIMUM_COIN_IN' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'ENUM_STATUS' END, CASE WHEN o_orderkey % 8 = 0 THEN 'TYPE_LINE' END, CASE WHEN o_orderkey % 9 = 0 THEN 'FORMAT_DAY' END, CASE WHEN o_orderkey % 10 = 0 THEN 'UNKNOWN_FIELD' END], lambda x: x IS NOT NULL) AS r FROM orders)
  SELECT n, array_to_string(list_sort(r), ',') AS failed FROM f""")
def contract_check(spark, sf):
    i = F.col("o_orderkey")
    pairs = {
        "event_id": i.cast("string"), "event_type": F.when(i % 6 == 0, "X").otherwise("SLOT_PLAY"), "coin_in": F.when(i % 5 == 0, None).when(i % 7 == 0, "-1").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        "status": F.col("o_orderstatus"), "line": F.when(i % 8 == 0, "x").otherwise("3"), "day": F.when(i % 9 == 0, "never").otherwise(F.to_date("o_orderdate").cast("string")),
    }
    base = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    payload = F.when(i % 10 == 0, F.map_concat(base, F.create_map(F.lit("extra"), F.lit("1")))).otherwise(base)
    orders = read(spark, sf, "orders").select(i.alias("n"), payload.alias("payload"))
    return orders.select("n", F.array_join(C.reasons(C.from_json_schema(SLOT_SCHEMA)), ",").alias("failed"))


@query("topic_validate", """SELECT event_id AS n, CASE WHEN event_type IN ('click', 'view') THEN 'guest.' || event_type || '.v1' END AS known_topic, CASE WHEN event_type IN ('click', 'view') THEN 'guest.' || event_type || '.v1.dlq' END AS dlq,
  CASE WHEN event_type NOT IN ('click', 'view') THEN 'quarantine' WHEN event_id % 5 = 0 THEN 'duplicate_ignored' ELSE 'processed' END AS status FROM events""")
def topic_validate(spark, sf):
    catalog = spark.createDataFrame([("guest.click.v1", 7), ("guest.view.v1", 3)], "topic string, retention_days int")
    e = read(spark, sf, "events").select(F.col("event_id").alias("n"), F.concat(F.lit("guest."), "event_type", F.lit(".v1")).alias("topic"))
    out = e.join(catalog.withColumnRenamed("topic", "known_topic"), F.col("topic") == F.col("known_topic"), "left")
    status = F.when(F.col("known_topic").isNull(), "quarantine").when(F.col("n") % 5 == 0, "duplicate_ignored").otherwise("processed")
    return out.select("n", "known_topic", S.dead_letter_topic(F.col("known_topic")).alias("dlq"), status.alias("status"))


@query("topic_reasons", """SELECT event_id AS n, coalesce(array_to_string(list_sort(list_filter([CASE WHEN event_type NOT IN ('click', 'view') THEN 'UNKNOWN_TOPIC' END, CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 'EVENT_ID_REQUIRED' END,
  CASE WHEN event_id % 19 = 0 THEN 'PROPERTY_REQUIRED' END, CASE WHEN event_type = 'click' AND (event_id % 17 = 0 OR event_id % 7 = 0) THEN 'SCHEMA_VERSION_UNSUPPORTED' END,
  CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 OR event_id % 41 = 0 THEN 'PAYLOAD_NOT_OBJECT' END], lambda x: x IS NOT NULL)), ','), '') AS reasons FROM events""")
def topic_reasons(spark, sf):
    """The version of views is open; messages have defects by event id."""
    i = F.col("event_id")
    every = lambda n: i % n == 0
    catalog = spark.createDataFrame([("guest.click.v1", "1"), ("guest.view.v1", None)], "known_topic string, known_version string")
    e = read(spark, sf, "events").select(
        i.alias("n"), F.concat(F.lit("guest."), "event_type", F.lit(".v1")).alias("topic"), F.when(every(89), "").when(~every(97), i.cast("string")).alias("event_id"),
        F.when(~every(19), F.lit("P1")).alias("property_code"), F.when(every(17), "9").when(~every(7), "1").alias("schema_version"),
        F.when(every(31), "[1]").when(every(37), '{"a": ').when(~every(41), '{"a": 1}').alias("payload"))
    out = e.join(catalog, F.col("topic") == F.col("known_topic"), "left")
    return out.select("n", F.concat_ws(",", C.reasons(C.topic_checks())).alias("reasons"))


@query("gateway_status", """SELECT event_id AS n, CASE WHEN NOT coalesce(event_type IN ('click', 'view', 'purchase'), false) THEN 404 WHEN event_id % 23 = 0 THEN 422 WHEN event_id % 11 = 0 THEN 409 ELSE 200 END AS status FROM events""")
def gateway_status(spark, sf):
    """Keys that are absent or empty are no conflict."""
    i = F.col("event_id")
    key = F.when(i % 11 == 0, "other").when(i % 7 == 0, "").when(i % 3 != 0, i.cast("string"))
    valid = F.when(i % 46 == 0, F.lit(None)).otherwise(i % 23 != 0)
    return read(spark, sf, "events").select(i.alias("n"), C.gateway_status(F.col("event_type"), key, i.cast("string"), valid, ("CLICK", "VIEW", "PURCHASE")).alias("status"))


@query("derived_split", f"""WITH {RES} SELECT property_code, CASE WHEN reservation_id % 7 <> 0 AND revenue >= 1000 THEN 'land' ELSE 'reject' END AS route, count(*) AS n_rows FROM res GROUP BY 1, 2""")
def derived_split(spark, sf):
    r = reservations(spark, sf).withColumn("property_code", S.code(F.concat(F.lit("  "), F.lower("property_code"), F.lit(" "))))
    key = F.when(F.col("reservation_id") % 7 != 0, F.col("reservation_id"))
    good = F.coalesce(key.isNotNull() & (F.col("revenue") >= 1000), F.lit(False))
    return r.groupBy("property_code", F.when(good, "land").otherwise("reject").alias("route")).agg(F.count("*").alias("n_rows"))


@query("base_filters", f"""WITH {RES}, {GAME}, {REW} SELECT 'hotel' AS stream, count(*) AS n_rows FROM res WHERE reservation_id % 10 <> 0 UNION ALL SELECT 'slot', count(*) FROM game WHERE line IS NOT NULL
  UNION ALL SELECT 'mobile', count(*) FROM mob WHERE guest_id IS NOT NULL UNION ALL SELECT 'reward', count(*) FROM rew WHERE guest_id IS NOT NULL""")
def base_filters(spark, sf):
    frames = {"hotel": reservations(spark, sf).where(F.col("reservation_id") % 10 != 0), "slot": gaming(spark, sf).where("line is not null"), "mobile": mobile(spark, sf).where("guest_id is not null"), "reward": rewards(spark, sf).where("guest_id is not null")}
    out = None
    for name, df in frames.items():
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stream"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("staged_gaming", f"""WITH {GAME} SELECT property_code, count(*) AS plays, CAST(sum(coin_in) AS DOUBLE) AS coin_in FROM game WHERE event_ts <= TIMESTAMP '2000-06-01 00:00:00' + INTERVAL 5 MINUTE GROUP BY 1""")
def staged_gaming(spark, sf):
    g = gaming(spark, sf).where(F.col("event_ts") <= F.lit("2000-06-01 00:05:00").cast("timestamp_ntz"))
    text = g.withColumn("coin_in", F.col("coin_in").cast("string").try_cast("decimal(38,9)"))
    return text.groupBy("property_code").agg(F.count("*").alias("plays"), dbl(F.sum("coin_in")).alias("coin_in"))


@query("staged_reservations", f"""WITH {RES} SELECT status, count(*) AS n_rows FROM res WHERE rooms >= 0 AND stay_date BETWEEN DATE '1999-03-15' AND DATE '2002-03-15' GROUP BY 1""")
def staged_reservations(spark, sf):
    today = F.lit("2000-03-15").cast("date")
    return reservations(spark, sf).where((F.col("rooms") >= 0) & F.col("stay_date").between(F.add_months(today, -12), F.add_months(today, 24))).groupBy("status").agg(F.count("*").alias("n_rows"))


@query("null_key_diagnostics", """SELECT 'orders' AS entity, count(*) FILTER (WHERE o_custkey IS NULL) AS violations FROM orders UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE l_partkey IS NULL OR l_suppkey IS NULL) FROM lineitem
  UNION ALL SELECT 'rewards', count(*) FILTER (WHERE event_id % 10 = 0) FROM events WHERE event_type IN ('purchase', 'signup') UNION ALL SELECT 'customer', count(*) FILTER (WHERE c_nationkey IS NULL) FROM customer UNION ALL SELECT 'part', count(*) FILTER (WHERE p_brand IS NULL) FROM part""")
def null_key_diagnostics(spark, sf):
    n = lambda c: F.col(c).isNull()
    t = lambda name: read(spark, sf, name)
    return R.diagnostics({"orders": (t("orders"), n("o_custkey")), "lineitem": (t("lineitem"), n("l_partkey") | n("l_suppkey")), "rewards": (rewards(spark, sf), n("guest_id")), "customer": (t("customer"), n("c_nationkey")), "part": (t("part"), n("p_brand"))})


@query("date_amount_diagnostics", """SELECT 'shipped_after_2001' AS entity, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2001-01-01') AS violations FROM lineitem UNION ALL SELECT 'future_events', count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:05:00') FROM events
  UNION ALL SELECT 'negative_balance', count(*) FILTER (WHERE c_acctbal < 0 AND c_mktsegment NOT IN ('MACHINERY', 'BUILDING')) FROM customer""")
def date_amount_diagnostics(spark, sf):
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    t = lambda name: read(spark, sf, name)
    return R.diagnostics({
        "shipped_after_2001": (t("lineitem"), F.col("l_shipdate") > ntz("2001-01-01 00:00:00")), "future_events": (t("events"), F.col("ts") > ntz("2024-01-20 00:00:00") + F.expr("INTERVAL 5 MINUTES")),
        "negative_balance": (t("customer"), (F.col("c_acctbal") < 0) & ~F.col("c_mktsegment").isin("MACHINERY", "BUILDING"))})


@query("recency_diagnostics", """SELECT 'last_hour' AS entity, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS violations FROM events
  UNION ALL SELECT 'last_5_minutes', count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 5 MINUTE AND ts <= TIMESTAMP '2024-01-20 12:00:00') FROM events
  UNION ALL SELECT 'open_critical', count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') FROM orders""")
def recency_diagnostics(spark, sf):
    now, e = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), read(spark, sf, "events")
    within = lambda i: F.col("ts").between(now - F.expr(f"INTERVAL {i}"), now)
    return R.diagnostics({"last_hour": (e, within("1 HOUR")), "last_5_minutes": (e, within("5 MINUTES")), "open_critical": (read(spark, sf, "orders"), (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))})


@query("normalize_codes", r"""SELECT doc_id, upper(trim(lang)) AS lang_code, nullif(upper(trim('  ')), '') AS empty_code, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_md5 FROM documents""")
def normalize_codes(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", S.code(F.col("lang")).alias("lang_code"), S.code(F.lit("  ")).alias("empty_code"), F.md5(F.coalesce(S.squeezed(F.col("text")), F.lit(""))).alias("text_md5"))


@query("safe_casts", """SELECT event_id AS n, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 3 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS amount, CASE WHEN event_id % 4 <> 0 AND event_id % 3 = 0 THEN true ELSE false END AS amount_malformed,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS guest, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 100.0 / (user_id + 1) END AS ratio FROM events""")
def safe_casts(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.lit(" ")).when(i % 3 == 0, F.lit("1,5x")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    guest = F.when(i % 3 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))
    ratio = F.coalesce(S.safe_divide(F.lit(100.0), F.when(i % 2 == 0, 0.0).otherwise((F.col("user_id") + 1).cast("double"))), F.lit(0.0))
    return read(spark, sf, "events").select(i.alias("n"), dbl(S.decimal_or_null(text)).alias("amount"), S.malformed(text, "decimal(18,2)").alias("amount_malformed"), S.int_or_null(guest).alias("guest"), ratio.alias("ratio"))


@query("parse_times", """SELECT event_id AS n, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(CASE WHEN event_id % 3 = 1 THEN ts - INTERVAL 2 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') END AS event_ts,
  CASE WHEN event_id % 3 = 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS zoned_ts FROM events""")
def parse_times(spark, sf):
    i = F.col("event_id")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(i % 3 == 0, F.lit("soon")).when(i % 3 == 1, F.concat(base, F.lit("+02:00"))).otherwise(base)
    show = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf, "events").select(i.alias("n"), F.when(i % 3 == 1, show(S.utc_time(text))).otherwise(text_ts(S.utc_time(text))).alias("event_ts"), show(S.zoned_time(text)).alias("zoned_ts"))


@query("time_buckets", "SELECT event_id AS n, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bucket, CAST(ts AS DATE) AS event_date, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS BIGINT) AS seconds_since FROM events")
def time_buckets(spark, sf):
    since = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return read(spark, sf, "events").select(F.col("event_id").alias("n"), text_ts(S.bucket(F.col("ts"), "5 minutes")).alias("bucket"), F.to_date("ts").alias("event_date"), since.alias("seconds_since"))


@query("business_keys", """SELECT event_id AS n, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END, '<null>') || '||' || event_type AS business_key, 'events:P' || CAST(user_id % 4 AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) AS canonical_key,
  'P' || CAST(user_id % 4 AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) AS ordering_key, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS first_key FROM events""")
def business_keys(spark, sf):
    i = F.col("event_id")
    guest, prop = F.when(i % 3 != 0, F.col("user_id")), F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string"))
    return read(spark, sf, "events").select(
        i.alias("n"), S.business_key(guest, F.col("event_type")).alias("business_key"), S.canonical_key(F.lit("events"), prop, i).alias("canonical_key"),
        S.ordering_key(prop, i).alias("ordering_key"), S.first_key(F.lit(""), guest, i).alias("first_key"))


@query("stable_event_id", "SELECT event_id AS n, upper(substr(sha256('guest.' || event_type || '.v1|P' || CAST(user_id % 4 AS VARCHAR) || '|' || CAST(user_id AS VARCHAR) || '|' || CAST(event_id AS VARCHAR)), 1, 32)) AS stable_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || CAST(user_id AS VARCHAR) || '}') AS content_hash FROM events")
def stable_event_id(spark, sf):
    prop = F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string"))
    topic = F.concat(F.lit("guest."), "event_type", F.lit(".v1"))
    return read(spark, sf, "events").select(F.col("event_id").alias("n"), S.stable_event_id(topic, prop, F.col("user_id"), F.col("event_id")).alias("stable_id"), S.stable_hash(user_id=F.col("user_id"), event_type=F.col("event_type")).alias("content_hash"))


WORKLOADS = """w AS (SELECT p_partkey AS workload_id, CASE p_partkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS criticality, p_partkey % 3 = 0 AS pii, CAST(p_partkey AS BIGINT) * 137000 AS daily_rows,
  p_size AS sla_minutes, p_partkey % 7 AS deps, CASE WHEN p_partkey % 2 = 0 THEN 'DB2+X' ELSE 'SQL+X' END AS platform FROM part)"""


def workloads(spark, sf):
    k = F.col("p_partkey")
    level = F.when(k % 5 == 0, "LOW").when(k % 5 == 1, "MEDIUM").when(k % 5 == 2, "HIGH").when(k % 5 == 3, "CRITICAL").otherwise("UNKNOWN")
    return read(spark, sf, "part").select(k.alias("workload_id"), level.alias("criticality"), (k % 3 == 0).alias("pii"), (k.cast("long") * 137000).alias("daily_rows"), F.col("p_size").alias("sla_minutes"), (k % 7).alias("deps"), F.when(k % 2 == 0, "DB2+X").otherwise("SQL+X").alias("platform"))


RISK = """CAST(CASE criticality WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 5 WHEN 'CRITICAL' THEN 8 ELSE 5 END + CASE WHEN pii THEN 3 ELSE 0 END + CASE WHEN daily_rows > 100000000 THEN 3 WHEN daily_rows > 1000000 THEN 2 ELSE 0 END
  + CASE WHEN sla_minutes <= 5 THEN 2 WHEN sla_minutes <= 30 THEN 1 ELSE 0 END + least(4, deps) AS BIGINT)"""
PATTERN = "CASE WHEN sla_minutes <= 5 THEN 'EVENT_DRIVEN_DUAL_RUN' WHEN daily_rows > 50000000 THEN 'BULK_INCREMENTAL_PARALLEL' WHEN platform LIKE 'DB2%' THEN 'BOUNDED_WATERMARK_BATCH' ELSE 'BATCH_INCREMENTAL_RECONCILED' END"


@query("risk_score", f"WITH {WORKLOADS} SELECT workload_id, {RISK} AS risk_score FROM w")
def risk_score(spark, sf):
    c = F.col
    return workloads(spark, sf).select("workload_id", scoring.risk_score(c("criticality"), c("pii"), c("daily_rows"), c("sla_minutes"), c("deps")).cast("long").alias("risk_score"))


@query("recommended_pattern", f"WITH {WORKLOADS} SELECT workload_id, {PATTERN} AS pattern FROM w")
def recommended_pattern(spark, sf):
    return workloads(spark, sf).select("workload_id", scoring.migration_pattern(F.col("sla_minutes"), F.col("daily_rows"), F.col("platform")).alias("pattern"))


@query("work_item_score", """SELECT o_orderkey AS item, round_even(CAST(o_totalprice / 1000.0 AS DOUBLE) * 0.35 + CAST(o_orderkey % 50 AS DOUBLE) * 0.30 + CAST(o_custkey % 40 AS DOUBLE) * 0.20 + least(10.0, CAST((o_orderkey % 4) * 1.5 AS DOUBLE) + CAST((o_custkey % 3) * 2.0 AS DOUBLE))
  + CASE WHEN o_orderkey % 5 = 0 THEN 0.0 WHEN o_orderkey % 30 - 5 <= 0 THEN 10.0 ELSE greatest(0.0, 10.0 - CAST(o_orderkey % 30 - 5 AS DOUBLE) * 0.5) END + CASE o_orderkey % 5 WHEN 0 THEN 15.0 WHEN 1 THEN 10.0 WHEN 2 THEN 5.0 ELSE 0.0 END - least(20.0, CAST(o_custkey % 200 AS DOUBLE) / 8.0), 2) AS score FROM orders""")
def work_item_score(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    due = F.when(k % 5 != 0, (k % 30 - 5).cast("double"))
    score = scoring.work_item_score(F.col("o_totalprice") / 1000.0, (k % 50).cast("double"), (c % 40).cast("double"), (c % 200).cast("double"), due, (c % 3).cast("double"), (k % 4).cast("double"), F.concat(F.lit("P"), (k % 5).cast("string")))
    return read(spark, sf, "orders").select(k.alias("item"), score.alias("score"))


@query("signal_priority", """SELECT l_orderkey AS n, l_linenumber AS line, l_quantity AS value, least(100.0, 50 + abs(l_quantity - 25.0) / greatest(abs(25.0), 1e-9) * 50) AS priority, printf('Observed %.4f against %s threshold %.4f.', l_quantity, CASE WHEN l_linenumber % 2 = 0 THEN 'MAX' ELSE 'MIN' END, 25.0::DOUBLE) AS rationale
  FROM lineitem WHERE CASE WHEN l_linenumber % 2 = 0 THEN l_quantity > 25.0 ELSE l_quantity < 25.0 END""")
def signal_priority(spark, sf):
    v, t = F.col("l_quantity"), F.lit(25.0)
    direction = F.when(F.col("l_linenumber") % 2 == 0, "MAX").otherwise("MIN")
    rows = read(spark, sf, "lineitem").where(scoring.breached(v, t, direction))
    return rows.select(F.col("l_orderkey").alias("n"), F.col("l_linenumber").alias("line"), v.alias("value"), scoring.signal_priority(v, t).alias("priority"), scoring.signal_rationale(v, t, direction).alias("rationale"))


@query("finops_actions", """WITH c AS (SELECT s_suppkey AS workload, abs(s_acctbal) AS cost, CAST(s_suppkey % 40 AS DOUBLE) AS util, CAST(s_suppkey % 90 * 10 AS DOUBLE) AS p95 FROM supplier), a AS (SELECT *, CASE WHEN util < 15 AND p95 < 250 THEN 'RIGHTSIZE' WHEN util < 5 THEN 'SCHEDULE_OR_SCALE_TO_ZERO' WHEN p95 > 500 THEN 'PERFORMANCE_FIRST_NO_COST_CUT' END AS action FROM c)
  SELECT workload, action, CASE action WHEN 'RIGHTSIZE' THEN cost * 0.25 WHEN 'SCHEDULE_OR_SCALE_TO_ZERO' THEN cost * 0.5 ELSE 0.0 END AS savings, CASE action WHEN 'RIGHTSIZE' THEN 'LOW' WHEN 'SCHEDULE_OR_SCALE_TO_ZERO' THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM a WHERE action IS NOT NULL""")
def finops_actions(spark, sf):
    k = F.col("s_suppkey")
    advice = scoring.finops(F.abs("s_acctbal"), (k % 40).cast("double"), (k % 90 * 10).cast("double"), F.lit(500.0))
    return read(spark, sf, "supplier").select(k.alias("workload"), advice.alias("a")).where("a is not null").select("workload", "a.*")


@query("guest_features", """WITH g AS (SELECT o_custkey AS guest, CAST(count(*) AS DOUBLE) AS sessions, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS coin, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS room FROM orders GROUP BY 1)
  SELECT guest, sessions + CASE WHEN guest % 3 = 0 THEN 0 ELSE sessions END * 0.25 + (guest % 7) * 0.10::DOUBLE AS engagement_intensity, CAST(coin + coalesce(room, 0) AS DOUBLE) AS cross_domain_value FROM g""")
def guest_features(spark, sf):
    price, none = F.col("o_totalprice").cast("decimal(18,2)"), F.lit(None).cast("double")
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("guest")).agg(
        F.count("*").cast("double").alias("gaming_sessions_30d"), F.sum(price).alias("coin_in_30d"), F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("room_revenue_90d"))
    g = g.withColumns({"mobile_sessions_30d": F.when(F.col("guest") % 3 != 0, F.col("gaming_sessions_30d")), "offer_views_30d": (F.col("guest") % 7).cast("double"), **dict.fromkeys(("days_since_last_visit", "actual_win_30d", "hotel_nights_90d", "reward_redemptions_90d"), none)})
    out = g.withColumns(scoring.guest_features(g.columns))
    return out.select("guest", "engagement_intensity", dbl("cross_domain_value").alias("cross_domain_value"))


@query("computed_columns", f"WITH {GAME} SELECT property_code, CAST(sum(coin_in - payout - jackpot) AS DOUBLE) AS net_win, CAST(count(*) FILTER (WHERE payout > jackpot) AS DOUBLE) / count(*) AS failure_rate FROM game GROUP BY 1")
def computed_columns(spark, sf):
    g = gaming(spark, sf).withColumn("net_win", S.net_win(F.col("coin_in"), F.col("payout"), F.col("jackpot")))
    return g.groupBy("property_code").agg(dbl(F.sum("net_win")).alias("net_win"), S.safe_divide(F.count_if(F.col("payout") > F.col("jackpot")).cast("double"), F.count("*").cast("double")).alias("failure_rate"))


@query("retry_backoff", "SELECT n_nationkey AS attempt, least(30.0, 0.25 * pow(2.0, greatest(0, n_nationkey - 1))) AS seconds FROM nation")
def retry_backoff(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("attempt"), S.backoff(F.col("n_nationkey")).alias("seconds"))


@query("topic_names", "SELECT DISTINCT 'guest.' || event_type || '.v1' AS topic, 'guest.' || event_type || '.v1.dlq' AS dlq, 'prod-guest-' || event_type || '-v1-consumer-v1' AS subscription, lower('Guest Desk-' || event_type) AS raw_slug, replace(lower('Guest Desk-' || event_type), ' ', '-') AS slug FROM events")
def topic_names(spark, sf):
    t = read(spark, sf, "events").select("event_type", F.concat(F.lit("guest."), "event_type", F.lit(".v1")).alias("topic")).distinct()
    return t.select("topic", S.dead_letter_topic(F.col("topic")).alias("dlq"), S.subscription_name(F.col("topic"), "prod").alias("subscription"), F.lower(F.concat(F.lit("Guest Desk-"), "event_type")).alias("raw_slug"), S.slug(F.lit("Guest Desk"), F.col("event_type")).alias("slug"))


@query("dq_rates", f"""WITH {MOB} SELECT action, count(*) AS checked, count(*) FILTER (WHERE amount < 10) AS failed, CAST(count(*) FILTER (WHERE amount < 10) AS DOUBLE) / count(*) AS rate, CASE WHEN CAST(count(*) FILTER (WHERE amount < 10) AS DOUBLE) / count(*) < 0.10 THEN 'PASS' WHEN CAST(count(*) FILTER (WHERE amount < 10) AS DOUBLE) / count(*) < 0.25 THEN 'REVIEW' ELSE 'BLOCK' END AS class FROM mob GROUP BY 1""")
def dq_rates(spark, sf):
    m = mobile(spark, sf).groupBy("action").agg(F.count("*").alias("checked"), F.count_if(F.col("amount") < 10).alias("failed"))
    rate = F.col("failed").cast("double") / F.col("checked")
    return m.withColumn("rate", rate).withColumn("class", scoring.drift_class(F.col("rate")))


@query("domain_reasons", """WITH e AS (SELECT event_id AS i, user_id AS u, CAST(event_id % 4 AS INTEGER) AS k, CAST(value AS DECIMAL(18,2)) - 50 AS coin FROM events),
  r AS (SELECT ['SLOT_PLAY', 'REWARD_ACTIVITY', 'PAYMENT', 'WORK_ORDER'][k + 1] AS event_type, CASE k
    WHEN 0 THEN concat_ws(',', CASE WHEN coin < 0 THEN 'COIN_IN_NEGATIVE' END, CASE WHEN i % 3 = 0 THEN 'MACHINE_ID_REQUIRED' END, CASE WHEN i % 11 = 0 THEN 'PAYOUT_NEGATIVE' END, CASE WHEN i % 5 = 0 THEN 'PLAY_ID_REQUIRED' END)
    WHEN 1 THEN concat_ws(',', CASE WHEN u % 2 <> 0 THEN 'GUEST_ID_REQUIRED' END, CASE WHEN i % 5 = 0 THEN 'REWARD_EVENT_ID_REQUIRED' END)
    WHEN 2 THEN concat_ws(',', CASE WHEN i % 3 = 0 THEN 'CURRENCY_UNSUPPORTED' END, CASE WHEN i % 5 = 0 THEN 'TRANSACTION_ID_REQUIRED' END)
    ELSE concat_ws(',', CASE WHEN i % 7 = 0 THEN 'CLOSED_BEFORE_OPENED' END, CASE WHEN i % 5 = 0 THEN 'WORK_ORDER_ID_REQUIRED' END) END AS reasons FROM e)
  SELECT event_type, reasons, count(*) AS n_rows FROM r GROUP BY 1, 2""")
def domain_reasons(spark, sf):
    """The four domains' validators over payloads made of events."""
    i, c = F.col("event_id"), F.col
    some_id = F.when(i % 5 != 0, i.cast("string"))
    fields = {
        "play_id": some_id, "machine_id": F.when(i % 3 == 0, "").otherwise("m"), "coin_in": (c("value").cast("decimal(18,2)") - 50).cast("string"), "payout": F.when(i % 11 == 0, "-1").otherwise("1"),
        "reward_event_id": some_id, "guest_id": F.when(c("user_id") % 2 == 0, c("user_id").cast("string")), "transaction_id": some_id, "currency": F.when(i % 3 == 0, "eur").otherwise(" usd "),
        "work_order_id": some_id, "opened_at": F.lit("2024-01-02 00:00:00"), "closed_at": F.when(i % 7 == 0, "2024-01-01 00:00:00").otherwise("2024-01-03 00:00:00"),
    }
    kinds = F.array(*[F.lit(k) for k in ("SLOT_PLAY", "REWARD_ACTIVITY", "PAYMENT", "WORK_ORDER")])
    e = read(spark, sf, "events").select(F.element_at(kinds, (i % 4 + 1).cast("int")).alias("event_type"), F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]).alias("payload"))
    out = e.select("event_type", F.array_join(C.reasons(C.domain_checks(c("event_type"))), ",").alias("reasons"))
    return out.groupBy("event_type", "reasons").agg(F.count("*").alias("n_rows"))
