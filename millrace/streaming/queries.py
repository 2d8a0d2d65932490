"""Continuous queries on Structured Streaming: one specification drives the raw, clean, quarantine and merge queries of a domain."""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import business_key
from ..operators.contracts import StreamContract, add_quality_status, parse_envelope
from ..operators.control import SnapshotTable
from ..operators.merge import snapshot
from ..sources.readers import SourceSpec, add_source_metadata, read_stream
from ..sources.writers import write_history
from .health import progress, with_health


@dataclass(frozen=True)
class QuerySpec:
    """A domain's continuous queries. trigger: an interval, 'available now', or 'continuous <interval>'."""

    name: str
    source: SourceSpec
    contract: StreamContract
    root: str
    watermark: str = "10 minutes"
    trigger: str = "15 seconds"
    version: str = "source_version"
    updated: str = "source_updated_at"
    max_batch_seconds: float = 120.0
    max_lag_seconds: float | None = None

    def path(self, zone: str) -> str:
        return f"{self.root}/{zone}/{self.contract.domain}/{self.name}"

    def checkpoint(self, part: str) -> str:
        return f"{self.root}/checkpoints/{self.name}/{part}"


def validate(spec: QuerySpec) -> None:
    """A continuous trigger knows no watermark, deduplication or foreachBatch."""
    if not spec.name or not spec.contract.key:
        raise ValueError("a query needs a name and key columns")
    if spec.trigger.startswith("continuous"):
        raise ValueError("a continuous trigger cannot run stateful deduplication or foreachBatch")


def _trigger(writer, spec: QuerySpec):
    return writer.trigger(availableNow=True) if spec.trigger == "available now" else writer.trigger(processingTime=spec.trigger)


def validated(spark: SparkSession, spec: QuerySpec) -> DataFrame:
    """The parsed stream with its quality columns; event_ts is a timestamp."""
    parsed = parse_envelope(add_source_metadata(read_stream(spark, spec.source)), spec.contract)
    checked = add_quality_status(parsed, spec.contract)
    return checked.withColumn("event_ts", F.try_to_timestamp("event_ts"))


def clean(df: DataFrame, spec: QuerySpec, streaming: bool = True) -> DataFrame:
    """Valid events, one of each event_id within the watermark, with their business key and date."""
    valid = df.where("_dq_valid")
    once = valid.withWatermark("event_ts", spec.watermark).dropDuplicatesWithinWatermark(["event_id"]) if streaming else valid.dropDuplicates(["event_id"])
    return once.withColumns({"_business_key": business_key(*[F.col(c) for c in spec.contract.key]), "business_date": F.to_date("event_ts")})


def quarantined(df: DataFrame) -> DataFrame:
    return df.where("NOT _dq_valid").withColumn("quarantine_date", F.to_date("_ingested_at"))


def merge_batch(spec: QuerySpec, target: SnapshotTable) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the batch joins the history under its id, then the snapshot; both do nothing new when a batch is retried."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_history(batch, spec.path("history"), batch_id)
        order = [F.coalesce(F.col(spec.version).cast("bigint"), F.lit(0)).alias("_version"), F.to_timestamp(spec.updated).alias("_updated")]
        rows = batch.select("*", *order) if spec.version in batch.columns else batch.withColumns({"_version": F.lit(0).cast("bigint"), "_updated": F.col("event_ts")})
        target.replace(batch_id, lambda stored: snapshot(stored, rows, ["_business_key"], ["_version", "_updated", "event_id"]))

    return run


def late_batch(spec: QuerySpec, seen: SnapshotTable) -> Callable[[DataFrame, int], None]:
    """foreachBatch: valid events that are older than the watermark of the batches before go to the late zone, as the clean query drops them unseen.

    The greatest event time is a snapshot by batch id, so a batch that is retried is measured as it was the first time.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        now = seen.version()
        if now is not None and batch_id <= now:
            return
        before = None if now is None else seen.read().first()["high"]
        delay = int(batch.sparkSession.sql(f"SELECT CAST(INTERVAL {spec.watermark} AS INTERVAL DAY TO SECOND) AS d").first()["d"].total_seconds() * 1000)
        valid = batch.where("_dq_valid")
        _, late = split_late(valid, "event_ts", None if before is None else before - delay)
        write_history(late, spec.path("late"), batch_id)
        high = valid.agg(F.max(F.unix_millis("event_ts"))).first()[0]
        highs = [h for h in (before, high) if h is not None]
        if highs:
            seen.replace(batch_id, lambda _: batch.sparkSession.createDataFrame([(max(highs),)], "high long"))

    return run


def retrying(step: Callable[[DataFrame, int], None], dead_letters: str, attempts: int = 10, wait: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """foreachBatch that runs step again after an error, waiting twice as long each time up to 30 seconds; after the last attempt the batch
    goes to dead_letters under its id, with the error, and the stream goes on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(attempts):
            try:
                return step(batch, batch_id)
            except Exception as e:  # whatever a step or its sink raises
                error = str(e)
                if attempt + 1 < attempts:
                    wait(min(30.0, 0.25 * 2**attempt))
        write_history(batch.withColumns({"_error": F.lit(error[:2_000]), "_attempts": F.lit(attempts)}), dead_letters, batch_id)

    return run


def append(df: DataFrame, path: str, checkpoint: str, name: str, spec: QuerySpec, partition: str | None = None) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").queryName(name).option("checkpointLocation", checkpoint).option("path", path)
    return _trigger(writer.partitionBy(partition) if partition else writer, spec).start()


def start(spark: SparkSession, spec: QuerySpec) -> list[StreamingQuery]:
    """Raw, clean, quarantine, late and canonical merge, each with a checkpoint of its own; a batch whose merge fails ten times goes to dead letters."""
    validate(spec)
    stream = validated(spark, spec)

    def each(df: DataFrame, part: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
        return _trigger(df.writeStream.foreachBatch(step).queryName(f"{spec.name}_{part}").option("checkpointLocation", spec.checkpoint(part)), spec).start()

    return [
        append(add_source_metadata(read_stream(spark, spec.source)), spec.path("raw"), spec.checkpoint("raw"), f"{spec.name}_raw", spec),
        append(clean(stream, spec), spec.path("clean"), spec.checkpoint("clean"), f"{spec.name}_clean", spec, "business_date"),
        append(quarantined(stream), spec.path("quarantine"), spec.checkpoint("quarantine"), f"{spec.name}_quarantine", spec, "_dq_reason"),
        each(stream, "late", late_batch(spec, SnapshotTable(spark, spec.path("late_marks")))),
        each(clean(stream, spec), "merge", retrying(merge_batch(spec, SnapshotTable(spark, spec.path("merge"))), spec.path("dead_letters"))),
    ]


def split_late(batch: DataFrame, event_ts: str, watermark_ms: int | None) -> tuple[DataFrame, DataFrame]:
    """(in time, late) by the watermark of the batch before: late rows go to quarantine rather than being dropped unseen."""
    if watermark_ms is None:
        return batch, batch.limit(0).withColumn("_dq_reason", F.lit("LATE_EVENT"))
    late = F.unix_millis(F.col(event_ts).cast("timestamp")) < watermark_ms
    return batch.where(~late), batch.where(late).withColumn("_dq_reason", F.lit("LATE_EVENT"))


def replay(spark: SparkSession, spec: QuerySpec, start_ts: str, end_ts: str, replay_id: int) -> DataFrame:
    """The merged snapshot after a bounded replay of the raw zone through the same checks; live checkpoints are not touched.

    Both bounds are required. Merging is idempotent, so events that were applied before change nothing.
    """
    if not start_ts or not end_ts:
        raise ValueError("a replay needs both bounds")
    raw = spark.read.parquet(spec.path("raw"))
    checked = add_quality_status(parse_envelope(raw, spec.contract), spec.contract).withColumn("event_ts", F.try_to_timestamp("event_ts"))
    bounded = checked.where(F.col("event_ts").between(F.to_timestamp(F.lit(start_ts)), F.to_timestamp(F.lit(end_ts))))
    target = SnapshotTable(spark, spec.path("merge"))
    merge_batch(spec, target)(clean(bounded, spec, streaming=False), max(replay_id, (target.version() or 0) + 1))
    return target.read()


@dataclass
class Supervisor:
    """Starts all queries of a group, reports on them and stops them within a deadline."""

    spark: SparkSession
    specs: list[QuerySpec]
    queries: dict[str, tuple[QuerySpec, StreamingQuery]] = field(default_factory=dict)

    def start(self) -> None:
        for spec in self.specs:
            for q in start(self.spark, spec):
                self.queries[q.name] = (spec, q)

    def await_all(self) -> None:
        for _, q in self.queries.values():
            q.awaitTermination()

    def watch(self, seconds: float = 5.0, stop_on: tuple[int, ...] = (signal.SIGTERM, signal.SIGINT)) -> dict[str, str]:
        """Waits for any query to end: (name -> error) of those that failed, after the others have been stopped. Signals stop all, too. For the main thread."""
        told = threading.Event()
        before = {s: signal.signal(s, lambda *_: told.set()) for s in stop_on}
        try:
            while not told.is_set() and any(q.isActive for _, q in self.queries.values()):
                failed = {n: str(q.exception()) for n, (_, q) in self.queries.items() if not q.isActive and q.exception()}
                if failed:
                    break
                told.wait(seconds)
        finally:
            for s, handler in before.items():
                signal.signal(s, handler)
            self.stop()
        return {n: str(q.exception()) for n, (_, q) in self.queries.items() if q.exception()}

    def health(self, as_of: Column | None = None) -> DataFrame:
        """A row for each query: its figures, state and why."""
        rows = [(n, q.isActive, json.dumps(dict(q.lastProgress), default=str) if q.lastProgress else None, spec.max_batch_seconds, spec.max_lag_seconds) for n, (spec, q) in self.queries.items()]
        reports = self.spark.createDataFrame(rows, "query_name string, active boolean, report string, max_batch_seconds double, max_lag_seconds double")
        return with_health(progress(reports), F.current_timestamp() if as_of is None else as_of).drop("report")

    def stop(self, seconds: float = 60.0) -> list[str]:
        """Names of the queries that were still running at the deadline."""
        until = time.monotonic() + seconds
        for _, q in self.queries.values():
            try:
                q.stop()
            except StreamingQueryException:
                pass  # it had failed before; its error is in q.exception()
        while time.monotonic() < until and any(q.isActive for _, q in self.queries.values()):
            time.sleep(0.1)
        return [n for n, (_, q) in self.queries.items() if q.isActive]
