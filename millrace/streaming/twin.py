"""Runs a streaming query over what a table holds now and gives its result as a frame."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="millrace-stream-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class _Streaming:
    """A session whose spark.read.parquet of one table gives the stream of its files; other tables are read as ever."""

    def __init__(self, spark: SparkSession, table: str):
        self._spark, self._table = spark, table

    def __getattr__(self, name: str):
        return getattr(self._spark, name)

    @property
    def read(self):
        return self

    def parquet(self, path: str) -> DataFrame:
        static = self._spark.read.parquet(path)
        if not path.endswith(f"/{self._table}.parquet"):
            return static
        return self._spark.readStream.schema(static.schema).parquet(f"{path}*")  # a pattern holds for a single file too


def run_available(spark: SparkSession, sf_dir: str, table: str, source: Callable, build: Callable[[DataFrame], DataFrame], mode: str, for_each: Callable | None = None) -> DataFrame | None:
    """build(source) as a query over the files of table, with the trigger available now; what it wrote, as a frame.

    Complete results are written batch after batch through foreachBatch, each over the one before; appended ones go to the file sink.
    """
    stream = build(source(_Streaming(spark, table), sf_dir))
    root = f"{scratch(spark)}/twin-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if for_each is not None:
        writer = writer.foreachBatch(for_each)
    elif mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{root}/out")
    query = writer.start()
    query.awaitTermination()
    return None if for_each is not None else spark.read.schema(stream.schema).parquet(f"{root}/out")
