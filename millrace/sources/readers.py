"""Readers: bounded extracts, streams behind one specification, push messages, text formats, freshness."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


@dataclass(frozen=True)
class ExtractSpec:
    """What a bounded extract reads: columns as name -> expression, the position column, and the key under its common name."""

    columns: dict[str, str]
    watermark: str
    key: str | None = None
    predicates: tuple[str, ...] = ()
    event_ts: str | None = None
    max_future: str = "5 MINUTES"

    def __post_init__(self):
        for name in (*self.columns, self.watermark, *([self.key] if self.key else [])):
            if not _IDENTIFIER.fullmatch(name):
                raise ValueError(f"not an identifier: {name}")


def bounded_extract(df: DataFrame, spec: ExtractSpec, low: int, high: int, as_of: Column | None = None, ordered: bool = False) -> DataFrame:
    """Rows with low < position <= high, projected; rows too far ahead of as_of are left out. The bounds reach the scan as pushed filters.

    With a key, the key and position also go out as source_business_key and source_watermark. A global order is only made if asked for.
    """
    rows = df.where((F.col(spec.watermark) > low) & (F.col(spec.watermark) <= high))
    for p in spec.predicates:
        rows = rows.where(p)
    if spec.event_ts and as_of is not None:
        rows = rows.where(F.col(spec.event_ts) < as_of + F.expr(f"INTERVAL {spec.max_future}"))
    out = [F.expr(e).alias(n) for n, e in spec.columns.items()]
    if spec.key:
        out += [F.col(spec.key).cast("string").alias("source_business_key"), F.col(spec.watermark).alias("source_watermark")]
    rows = rows.orderBy(spec.watermark) if ordered else rows
    return rows.select(*out)


def high_watermark(df: DataFrame, column: str) -> DataFrame:
    """One row: the greatest position, 0 of an empty source. Parquet answers it from its statistics where it can."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("high_watermark"))


def jdbc(spark: SparkSession, url: str, table: str, spec: ExtractSpec, low: int, high: int, partitions: int = 16, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """The bounded extract from a database: parallel range reads on the position column; needs a JDBC driver on the class path."""
    if not _IDENTIFIER.fullmatch(table):
        raise ValueError(f"not an identifier: {table}")
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), **options)
    reader = reader.options(partitionColumn=spec.watermark, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions))
    return bounded_extract(reader.load(), spec, low, high)


@dataclass(frozen=True)
class SourceSpec:
    """A stream of messages. format kafka reads topics; parquet, json and text read files that arrive in a folder."""

    format: str
    location: str
    schema: T.StructType | None = None
    starting: str = "latest"
    max_per_trigger: int | None = None
    min_partitions: int | None = None
    options: dict[str, str] = field(default_factory=dict)


def read_stream(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    reader = spark.readStream.format(spec.format).options(**spec.options)
    if spec.format == "kafka":
        reader = reader.option("subscribe", spec.location).option("startingOffsets", spec.starting).option("failOnDataLoss", "false")
        if spec.max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", spec.max_per_trigger)
        if spec.min_partitions:
            reader = reader.option("minPartitions", spec.min_partitions)
        return reader.load()
    if spec.max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", spec.max_per_trigger)
    return reader.schema(spec.schema).load(spec.location)


def add_source_metadata(df: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """The message columns under stable names and types, and when they were read. Columns a source lacks are null."""
    def col(name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    return df.select(
        col("key", "string").alias("_source_key"), col("value", "string").alias("value"), col("topic", "string").alias("_source_topic"),
        col("partition", "int").alias("_source_partition"), col("offset", "bigint").alias("_source_offset"), col("timestamp", "timestamp").alias("_source_timestamp"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("_ingested_at"))


def decode_push(df: DataFrame, body: str = "body") -> DataFrame:
    """Push envelopes (JSON text): the message's id, attributes and base64 data as text; decode_error where there is no valid data."""
    schema = "message STRUCT<data: STRING, messageId: STRING, attributes: MAP<STRING, STRING>>, subscription STRING"
    m = df.withColumn("_m", F.from_json(body, schema))
    data = F.try_to_binary(F.col("_m.message.data"), F.lit("base64")).cast("string")
    return m.select(*df.columns, F.col("_m.message.messageId").alias("message_id"), F.col("_m.message.attributes").alias("attributes"), data.alias("payload")).withColumn(
        "decode_error", F.when(F.col("payload").isNull(), "INVALID_DATA").when(F.try_parse_json("payload").isNull(), "INVALID_JSON"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma, double quotes, backslash escape, header."""
    return spark.read.schema(schema).csv(path, sep=",", quote='"', escape="\\", header=True)


def freshness(df: DataFrame, loaded_at: str, as_of: Column, warn_seconds: int, error_seconds: int) -> DataFrame:
    """One row: the last load, its age in seconds, and pass, warn or error."""
    from ..functions.scalars import age_status

    last = df.agg(F.max(loaded_at).alias("max_loaded_at"))
    age = F.timestamp_diff("SECOND", F.col("max_loaded_at"), as_of)
    return last.withColumn("age_seconds", age).withColumn("status", age_status(F.col("age_seconds"), warn_seconds, error_seconds))


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Frames with drifting schemas as one, by name; columns that a frame lacks are null."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
