"""The query group end to end on files, replay, capped sessions in a stream, health, sources and sinks."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.operators.contracts import StreamContract
from millrace.operators.control import SnapshotTable
from millrace.plans import twin
from millrace.plans.semantic import Models
from millrace.sources import readers, writers
from millrace.streaming import health, specs
from millrace.streaming import queries as Q


def event(i, **more):
    base = {"event_id": str(i), "event_type": "SLOT_PLAY", "schema_version": "1", "source_system": "s", "property_code": "p", "event_ts": f"2024-01-01T00:{i % 60:02d}:00Z", "session_id": f"k{i % 3}", "source_version": str(i), "source_updated_at": "2024-01-01 00:00:00"}
    return json.dumps(base | more)


@pytest.fixture
def spec(tmp_path):
    (tmp_path / "in").mkdir()
    contract = StreamContract("gaming", "SLOT_PLAY", ("event_id", "property_code", "session_id"), ("session_id",), extra={"source_version": "string", "source_updated_at": "string"})
    return Q.QuerySpec("plays", readers.SourceSpec("text", f"{tmp_path}/in"), contract, f"file://{tmp_path}/out", trigger="available now"), tmp_path


def text_schema(spec):
    from dataclasses import replace

    from pyspark.sql.types import StringType, StructField, StructType

    return replace(spec, source=replace(spec.source, schema=StructType([StructField("value", StringType())])))


def run(spark, spec):
    group = Q.Supervisor(spark, [spec])
    group.start()
    group.await_all()
    return group


def test_group_twice_and_replay(spark, spec):
    spec, tmp = text_schema(spec[0]), spec[1]
    (tmp / "in" / "a.txt").write_text("\n".join([event(1), event(2), event(2), event(3, event_type="X"), "{", event(4, property_code=None)]) + "\n")
    group = run(spark, spec)
    read = lambda zone: spark.read.parquet(spec.path(zone))
    assert (read("raw").count(), read("clean").count(), read("quarantine").count()) == (6, 2, 3)
    assert {r._business_key: r.event_id for r in SnapshotTable(spark, spec.path("merge")).read().collect()} == {"k1": "1", "k2": "2"}
    assert {r.query_name for r in group.health().collect()} == {"plays_raw", "plays_clean", "plays_quarantine", "plays_late", "plays_merge"} and group.stop() == []
    (tmp / "in" / "b.txt").write_text(event(5) + "\n" + event(1) + "\n")
    run(spark, spec)
    merged = {r._business_key: r.event_id for r in SnapshotTable(spark, spec.path("merge")).read().collect()}
    assert merged == {"k1": "1", "k2": "5"}
    again = Q.replay(spark, spec, "2024-01-01 00:00:00", "2024-01-02 00:00:00", 50)
    assert {r._business_key: r.event_id for r in again.collect()} == merged
    with pytest.raises(ValueError):
        Q.replay(spark, spec, "", "2024-01-02 00:00:00", 51)


def test_continuous_trigger_is_refused(spec):
    from dataclasses import replace

    with pytest.raises(ValueError):
        Q.validate(replace(spec[0], trigger="continuous 1 second"))


def test_late_rows_have_a_reason(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "n int, ts timestamp")
    good, late = Q.split_late(rows, "ts", int(dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC).timestamp() * 1000))
    assert [r.n for r in good.collect()] == [2] and [(r.n, r._dq_reason) for r in late.collect()] == [(1, "LATE_EVENT")]


def test_capped_sessions_in_a_stream_equal_batch(spark, tmp_path):
    """All sessions of many keys, in files whose events overlap in time; a far event closes what came before it."""
    import random

    r, at = random.Random(3), dt.datetime(2024, 1, 1)
    times = {"g": [0, 100, 200, 300, 520, 820, 1121, 5000]} | {f"k{i}": sorted(r.sample(range(9_000), 40)) for i in range(6)}
    rows = [(k, at + dt.timedelta(seconds=t)) for k, ts in times.items() for t in ts]
    for n in range(3):
        part = sorted((x for x in rows if n * 3_000 <= (x[1] - at).total_seconds() < (n + 1) * 3_000), key=lambda _: r.random())
        spark.createDataFrame(part, "key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.createDataFrame([("end", at + dt.timedelta(days=9))], "key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    s = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("ts", "4000 seconds")
    out = s.groupBy("key").applyInPandasWithState(W.CappedSessionProcessor(300, 250), W.CappedSessionProcessor.OUTPUT, W.CappedSessionProcessor.STATE, "append", "EventTimeTimeout")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted((x.key, x.session_start, x.session_end, x.event_count) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = W.capped_sessions(spark.createDataFrame(rows, "key string, ts timestamp"), "ts", 300, 250, ["key"], {"n": F.count("*")})
    assert got == sorted((x.key, x.session_start, x.session_end, x.n) for x in batch.collect()) and len(got) > 60


def test_health(spark):
    report = {"batchId": 1, "numInputRows": 5, "inputRowsPerSecond": 10.0, "processedRowsPerSecond": 5.0, "durationMs": {"a": 130_000, "b": "x"}, "eventTime": {"watermark": "2024-01-01T00:00:00Z"}, "stateOperators": [{"numRowsTotal": 1}, {"numRowsTotal": 2, "numRowsUpdated": None}]}
    rows = [("slow", True, json.dumps(report), 120.0, 60.0), ("fine", True, json.dumps(report), 140.0, None), ("new", True, None, 1.0, None), ("off", False, json.dumps(report), 1.0, None), ("bad", True, "{", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "query_name string, active boolean, report string, max_batch_seconds double, max_lag_seconds double")
    out = {r.query_name: r for r in health.with_health(health.progress(df), F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()}
    assert (out["slow"].batch_duration_ms, out["slow"].state_rows_total, out["slow"].state_rows_updated, out["slow"].input_rows) == (130_000, 3, 0, 5)
    assert out["slow"].why == ["INPUT_OUTRUNS_PROCESSING", "TRIGGER_SLOW", "WATERMARK_LAGS"] and out["fine"].why == ["INPUT_OUTRUNS_PROCESSING"]
    assert [out[n].state for n in ("slow", "fine", "new", "off", "bad")] == ["DEGRADED", "DEGRADED", "STARTING", "STOPPED", "ACTIVE"]


def test_late_events_go_to_their_zone(spark, spec):
    spec, tmp = text_schema(spec[0]), spec[1]
    for name, events in (("a", [event(1), event(59)]), ("b", [event(2), event(55)])):
        (tmp / "in" / f"{name}.txt").write_text("\n".join(events) + "\n")
        run(spark, spec)
    assert [(r.event_id, r._dq_reason) for r in spark.read.parquet(spec.path("late")).collect()] == [("2", "LATE_EVENT")]


def test_a_batch_that_fails_is_retried_and_then_a_dead_letter(spark, tmp_path):
    calls, waits = [], []

    def step(batch, batch_id):
        calls.append(batch_id)
        if batch_id == 2 or len(calls) < 3:
            raise RuntimeError("sink is down")

    run_ = Q.retrying(step, f"file://{tmp_path}/dead", attempts=4, wait=waits.append)
    run_(spark.range(2), 1)
    assert calls == [1, 1, 1] and waits == [0.25, 0.5]
    run_(spark.range(3), 2)
    dead = spark.read.parquet(f"{tmp_path}/dead")
    assert calls[3:] == [2] * 4 and dead.count() == 3 and {(r._attempts, r._stream_batch_id) for r in dead.collect()} == {(4, 2)}


def test_supervisor_stops_the_rest_when_one_fails(spark, spec):
    from dataclasses import replace

    spec, _ = replace(text_schema(spec[0]), trigger="1 second"), spec[1]
    group = Q.Supervisor(spark, [spec])
    group.start()
    bad = spark.readStream.format("rate").load().writeStream.queryName("bad").foreachBatch(lambda b, i: 1 / 0).start()
    group.queries["bad"] = (spec, bad)
    failed = group.watch(seconds=0.2)
    assert list(failed) == ["bad"] and not any(q.isActive for _, q in group.queries.values())


def test_default_specs_and_windows(spark):
    assert [s.name for s in specs.default_specs("b:9092", "/x")] == ["hotel_events", "gaming_events", "rewards_events"]
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "k string, ts timestamp")
    assert [specs.windowed(df, d, "ts", ["k"], {"n": F.count("*")}).count() for d in ("hotel", "gaming", "mobile")] == [1, 10, 1]


def test_landing_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("1", dt.datetime(2024, 1, 1)), ("1", dt.datetime(2024, 1, 1)), ("2", dt.datetime(2024, 1, 2))], "event_id string, ts timestamp")
    for _ in range(2):
        writers.land(df, f"file://{tmp_path}/land", "ts")
    assert spark.read.parquet(f"{tmp_path}/land").count() == 2
    for _ in range(2):
        writers.write_history(df, f"file://{tmp_path}/history", 7)
    assert spark.read.parquet(f"{tmp_path}/history").count() == 3


def test_text_formats_and_topics(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "n int, t string")
    writers.write_delimited(df, f"{tmp_path}/csv", quote_all=True)
    assert sorted(map(tuple, readers.read_delimited(spark, f"{tmp_path}/csv", "n int, t string").fillna("").collect())) == [(1, 'a "quoted", text'), (2, "")]
    writers.write_quarantine(df.withColumn("reason", F.lit("R")), f"{tmp_path}/q")
    assert readers.read_jsonl(spark, f"{tmp_path}/q", "n int, t string, reason string").count() == 2
    writers.publish(writers.messages(df, "topic.v1", F.col("n").cast("string"), {"n": F.col("n")}), f"{tmp_path}/topics")
    assert spark.read.parquet(f"{tmp_path}/topics").where("topic = 'topic.v1'").count() == 2
    zones = writers.Zones("s3://lake")
    assert zones.zone("raw", "hotel", "r", dt.date(2024, 1, 2), 3) == "s3://lake/raw/hotel/r/business_date=2024-01-02/hour=03"
    assert zones.quarantine("h", "r", "X", dt.date(2024, 1, 2)).endswith("reason=X/business_date=2024-01-02") and zones.checkpoint("p", "q") == "s3://lake/checkpoints/p/q"


def test_extract_refuses_what_is_no_identifier():
    with pytest.raises(ValueError):
        readers.ExtractSpec({"a; drop": "a"}, "a")


def test_extract_pushes_its_bounds(spark, sf_dir):
    spec = readers.ExtractSpec({"k": "o_orderkey"}, "o_orderkey")
    plan = readers.bounded_extract(spark.read.parquet(f"{sf_dir}/orders.parquet"), spec, 1, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,1), LessThanOrEqual(o_orderkey,5)]" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_models(spark, tmp_path):
    m = Models(spark, f"file://{tmp_path}")
    m.add("base", lambda ref: spark.range(10).select("id", (F.col("id") % 2).alias("p")))
    m.add("mart", lambda ref: ref("base").groupBy("p").agg(F.count("*").alias("n")), "incremental", ("p",))
    assert m.ref("mart").count() == 2
    with pytest.raises(ValueError):
        m.add("x", lambda ref: ref("base"), "cube")


def test_modernisation_improves_p95(spark):
    base = twin.scenarios(spark, [{"name": "baseline"}])
    row = twin.paired(base, twin.modernised(base), hours=2, seed=7).first()
    assert row.latency_improvement_pct > 0 and row.additional_offer_responses > 0


def test_simulation_follows_its_seed_alone(spark):
    base = twin.scenarios(spark, [{"name": "a"}, {"name": "b", "outage_minutes": 60}])
    rows = {(r.name, r.seed): r for r in twin.simulate(base, hours=6, seeds=(1, 2)).collect()}
    again = {(r.name, r.seed): r for r in twin.simulate(base.repartition(5), hours=6, seeds=(1, 2)).collect()}
    assert rows == again and rows["a", 1].reservations == rows["b", 1].reservations != rows["a", 2].reservations
    assert abs(rows["a", 1].gaming_sessions / 6 - 900) < 300 and rows["a", 1].lost_events == 0 < rows["b", 1].lost_events
    assert 45 < rows["a", 1].mean_latency < 240 < rows["a", 1].p95_latency


def test_value_model(spark):
    df = spark.range(400).select(F.col("id").alias("t"), (F.col("id") % 17).cast("double").alias("x"), ((F.col("id") % 17) * 2.0).alias("y"))
    df = df.unionByName(spark.createDataFrame([(3, None, 0.0)], "t long, x double, y double"))
    _, mae, r2 = twin.train_value_model(df, ["x"], "y", "t", rounds=12, step=0.3)
    assert mae < 2 and r2 > 0.9
