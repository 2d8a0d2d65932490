"""Writers: zone paths, immutable landing, quarantine, topics as files, delimited text, publishing."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Zones:
    """Paths of the lake's zones under one root."""

    root: str

    def zone(self, zone: str, domain: str, entity: str, business_date: dt.date | None = None, hour: int | None = None) -> str:
        path = f"{self.root}/{zone}/{domain}/{entity}"
        if business_date is not None:
            path += f"/business_date={business_date.isoformat()}"
        return path + (f"/hour={hour:02d}" if hour is not None else "")

    def quarantine(self, domain: str, entity: str, reason: str, business_date: dt.date) -> str:
        return f"{self.root}/quarantine/{domain}/{entity}/reason={reason}/business_date={business_date.isoformat()}"

    def checkpoint(self, pipeline: str, query: str) -> str:
        return f"{self.root}/checkpoints/{pipeline}/{query}"


def land(df: DataFrame, path: str, event_ts: str, key: str = "event_id") -> DataFrame:
    """Append the rows whose key has not landed yet, partitioned by event date and hour, with a digest of each row; returns what was new.

    What has landed is read back by its key column alone.
    """
    spark = df.sparkSession
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    rows = df.dropDuplicates([key]).withColumns({"content_sha256": digest, "event_date": F.to_date(event_ts), "event_hour": F.hour(event_ts)})
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").partitionBy("event_date", "event_hour").parquet(path)
    return rows


def write_quarantine(df: DataFrame, path: str, reason: str = "reason") -> None:
    """Rejected rows as JSON lines by reason."""
    df.write.mode("append").partitionBy(reason).json(path)


def write_history(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch once: a retry overwrites its own partition alone."""
    df.withColumn("_stream_batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_stream_batch_id").parquet(path)


def write_delimited(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep=",", quote='"', escape="\\", header=True, quoteAll=quote_all)


def messages(df: DataFrame, topic: str, ordering_key: Column, attributes: dict[str, Column]) -> DataFrame:
    """(key, value, headers, topic): what a broker's sink takes; value is the row as JSON."""
    headers = F.create_map(*[x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))])
    return df.select(ordering_key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), headers.alias("headers"), F.lit(topic).alias("topic"))


def publish(rows: DataFrame, location: str, format: str = "parquet", **options: str) -> None:
    """Messages to Kafka, or to a folder by topic where there is no broker."""
    if format == "kafka":
        entries = F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")))
        rows.withColumn("headers", entries).write.format("kafka").options(**options).option("kafka.bootstrap.servers", location).option("includeHeaders", "true").save()
    else:
        rows.write.mode("append").format(format).partitionBy("topic").save(location)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 10_000, partitions: int | None = None, **options: str) -> None:
    """Rows to a database in batches, a transaction a partition; needs a JDBC driver on the class path.

    A task that is retried writes its rows again: load a staging table, and merge from there by key.
    """
    rows = df.coalesce(partitions) if partitions else df
    rows.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(batch_size), **options).save()
