"""The session that the engine expects."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

#: Fixed value: the state store that transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str, master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, RocksDB state. Partition counts are left to adaptive
    coalescing unless given; a cluster's own settings win over none of these but conf."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.streaming.stopGracefullyOnShutdown": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**settings, **conf}.items():
        b = b.config(key, value)
    return b.getOrCreate()


@dataclass(frozen=True)
class Settings:
    """What a deployment sets, from variables MILLRACE_<NAME>; numbers outside their bounds are errors."""

    environment: str = "dev"
    root: str = "file:///tmp/lake"
    brokers: str = ""
    batch_rows: int = 25_000
    fetch_size: int = 10_000
    trigger_seconds: int = 15

    #: Least and greatest.
    BOUNDS = {"batch_rows": (100, 1_000_000), "fetch_size": (100, 1_000_000), "trigger_seconds": (1, 3_600)}

    def __post_init__(self):
        for name, (least, greatest) in self.BOUNDS.items():
            if not least <= getattr(self, name) <= greatest:
                raise ValueError(f"{name} is not between {least} and {greatest}")

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None) -> Settings:
        environ = os.environ if environ is None else environ
        given = {f.name: environ[k] for f in fields(cls) if (k := f"MILLRACE_{f.name.upper()}") in environ}
        return cls(**{k: int(v) if k in cls.BOUNDS else v for k, v in given.items()})
