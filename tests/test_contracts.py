"""Rules, routing and the split: total under nulls, and nothing is lost between clean and quarantine."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions import scoring
from millrace.operators import contracts as C

SCHEMA = "event_id string, session_id string, event_type string, coin_in string, payload map<string,string>"


def evaluated(spark, rules, *rows):
    return C.evaluate(spark.createDataFrame(list(rows), SCHEMA), rules).collect()


def test_valid_play_passes(spark):
    rules = [C.required("event_id", "session_id"), C.allowed("event_type", ("SLOT_PLAY", "TABLE_PLAY")), C.non_negative("coin_in"), C.no_plaintext_sensitive_fields("payload")]
    good, bad, null = evaluated(spark, rules, ("e", "s", "slot_play", "20", {}), ("e", "", "X", "-1", {"SSN": "000"}), (None, None, None, None, None))
    assert good.valid and not good.violations
    assert [v.rule for v in bad.violations] == ["required:event_id,session_id", "allowed:event_type", "non_negative:coin_in", "sensitive_data_tokenization"]
    assert not null.valid and len(null.violations) == 3


def test_warning_does_not_invalidate(spark):
    row = evaluated(spark, [C.predicate("w", F.lit(False), "WARN")], ("e", "s", "x", "1", {}))[0]
    assert row.valid and row.violations[0].severity == "WARN"


def test_split_is_total_under_nulls(spark):
    contract = C.StreamContract("d", "T", ("event_id",), ("event_id",))
    raw = spark.createDataFrame([('{"event_id":"1","event_ts":"2024-01-01T00:00:00Z"}',), (None,), ("{",), ('{"event_id":"2","event_type":"t","schema_version":"1","event_ts":"2024-01-01T00:00:00Z"}',)], "value string")
    df = C.add_quality_status(C.parse_envelope(raw, contract), contract)
    assert df.where("_dq_valid").count() + df.where("NOT _dq_valid").count() == 4 and df.where("_dq_valid").count() == 1
    clean, bad = C.split(df.select("event_id", F.col("_dq_reason").alias("reason")), "reason")
    assert clean.count() == 1 and bad.count() == 3


def test_route_collects_all_reasons(spark):
    payload = {"currency": "EUR"}
    row = [("1", "payment", None, "P9", "9", payload), ("1", "payment", "S", "P0", "1", {"transaction_id": "t", "currency": "usd"}), ("1", "work_order", "S", "P0", "1", {"work_order_id": "w", "opened_at": "2024-01-02", "closed_at": "2024-01-01"}), ("1", "reward_activity", "S", "P0", "1", {})]
    df = spark.createDataFrame(row, "event_id string, event_type string, source_system string, property_code string, schema_version string, payload map<string,string>").withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    out = C.route(df, ("P0",), ("1",), F.lit("2024-01-01").cast("timestamp")).collect()
    assert out[0].reasons == ["CURRENCY_UNSUPPORTED", "PROPERTY_UNSUPPORTED", "SOURCE_SYSTEM_REQUIRED", "TRANSACTION_ID_REQUIRED", "UNSUPPORTED_SCHEMA_VERSION"]
    assert out[1].zone == "clean" and out[2].reasons == ["CLOSED_BEFORE_OPENED"] and out[3].reasons == ["GUEST_ID_REQUIRED", "REWARD_EVENT_ID_REQUIRED"]


def test_scalars(spark):
    row = spark.createDataFrame([(" ab ", "1,5", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00")], "a string, n string, z string, t string").select(
        S.code(F.col("a")).alias("code"), S.decimal_or_null(F.col("n")).alias("n"), S.malformed(F.col("n"), "decimal(18,2)").alias("bad"), S.zoned_time(F.col("z")).alias("z"), S.zoned_time(F.col("t")).alias("t"),
        S.safe_divide(F.lit(1.0), F.lit(0.0)).alias("d"), S.backoff(F.lit(20)).alias("b"), S.business_key(F.lit(None), F.lit("x")).alias("k")).first()
    assert row.code == "AB" and row.n is None and row.bad and row.z is not None and row.t is None and row.d is None and row.b == 30.0 and row.k == "<null>||x"


def test_low_utilisation_is_rightsized(spark):
    row = spark.range(1).select(scoring.finops(F.lit(1000.0), F.lit(10.0), F.lit(100.0), F.lit(500.0)).alias("a")).first().a
    assert row.action == "RIGHTSIZE" and row.savings == 250.0


def test_missing_feature_is_an_error():
    with pytest.raises(ValueError, match="coin_in_30d"):
        scoring.guest_features(["guest"])


def test_json_schema_compiles(spark):
    schema = {"required": ["id"], "properties": {"id": {"type": "string", "format": "uuid"}, "at": {"format": "date-time"}}, "additionalProperties": False}
    df = spark.createDataFrame([({"id": "x", "at": "y", "z": "1"},), ({"id": "123e4567-e89b-12d3-a456-426614174000"},), (None,)], "payload map<string,string>")
    got = [r[0] for r in df.select(C.reasons(C.from_json_schema(schema))).collect()]
    assert got == [["FORMAT_AT", "FORMAT_ID", "UNKNOWN_FIELD"], [], ["REQUIRED_ID"]]


def test_typed_events(spark):
    good = {"event_id": "123e4567-e89b-12d3-a456-426614174000", "event_ts": "2024-01-01T00:00:00Z", "event_type": "TABLE_PLAY", "source_system": "s", "property_code": "p", "session_id": "1", "table_token": "t", "game_code": "g", "buy_in": "1.50", "cash_out": "0", "average_bet": "2", "minutes_played": "1440"}
    rows = [(good,), (good | {"minutes_played": "1441", "event_ts": "2024-01-01T00:00:00", "extra": "1"},), ({"event_type": "NONE"},), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "payload map<string,string>").select(C.typed_event_failures()).collect()]
    assert got == [[], ["FORMAT_EVENT_TS", "MAXIMUM_MINUTES_PLAYED", "UNKNOWN_FIELD"], ["UNKNOWN_EVENT_TYPE"], ["UNKNOWN_EVENT_TYPE"]]


def test_settings_are_bounded():
    from millrace.session import Settings

    assert Settings.from_env({"MILLRACE_BATCH_ROWS": "500", "OTHER": "1"}).batch_rows == 500
    with pytest.raises(ValueError):
        Settings.from_env({"MILLRACE_BATCH_ROWS": "5"})
