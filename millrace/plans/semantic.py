"""The semantic layer: metrics, service levels and materialised models, as small registries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """A metric's expression at its grain."""

    name: str
    expression: str
    grain: str

    def column(self) -> Column:
        return F.expr(self.expression).alias(self.name)


#: Expressions and grains. Division is by try_divide, so a zero gives null.
METRICS = {m.name: m for m in (
    Metric("occupancy_pct", "try_divide(100.0 * rooms_sold, CAST(nullif(rooms_available, 0) AS DOUBLE))", "property_day"),
    Metric("adr", "try_divide(CAST(room_revenue AS DOUBLE), CAST(nullif(rooms_sold, 0) AS DOUBLE))", "property_day"),
    Metric("gaming_actual_win", "coin_in - payout - jackpot_amount", "property_5min"),
    Metric("guest_total_measured_value", "hotel_revenue + gaming_actual_win + dining_revenue + entertainment_revenue + spa_revenue", "guest_day"),
    Metric("pipeline_reconciliation_rate", "try_divide(CAST(balanced_runs AS DOUBLE), CAST(nullif(completed_runs, 0) AS DOUBLE))", "pipeline_day"),
)}


@dataclass(frozen=True)
class Slo:
    name: str
    objective: float
    window_days: int = 30
    alert_burn_rates: tuple[float, ...] = ()

    def burn_rate(self, sli: Column) -> Column:
        """How many times faster than allowed the error budget goes; null where there is no budget."""
        return F.try_divide(1 - sli, F.lit(1 - self.objective)) if self.objective < 1 else F.lit(None).cast("double")


#: Objectives.
SLOS = {s.name: s for s in (
    Slo("gaming_event_freshness", 0.995, alert_burn_rates=(14.4, 6.0, 3.0)),
    Slo("hotel_batch_completion", 0.999),
    Slo("reconciliation_balanced", 1.0),
    Slo("pubsub_delivery", 0.9999),
    Slo("data_contract_compatibility", 1.0),
)}


@dataclass
class Models:
    """Named transformations that refer to each other, built as views, tables or partitions that are replaced by key."""

    spark: SparkSession
    root: str
    builders: dict[str, tuple[Callable[[Callable[[str], DataFrame]], DataFrame], str, tuple[str, ...]]] = field(default_factory=dict)
    _views: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], materialised: str = "view", partition_by: tuple[str, ...] = ()) -> None:
        if materialised not in ("view", "table", "incremental"):
            raise ValueError(materialised)
        self.builders[name] = (build, materialised, partition_by)

    def ref(self, name: str) -> DataFrame:
        """The model's frame; a view is built once a session, a table when run or first referred to."""
        build, kind, _ = self.builders[name]
        if kind == "view":
            if name not in self._views:
                self._views[name] = build(self.ref)
            return self._views[name]
        if name not in self._views:
            self.run(name)
        return self._views[name]

    def run(self, name: str) -> None:
        build, kind, partition_by = self.builders[name]
        if kind == "view":
            return
        writer = build(self.ref).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if kind == "incremental":
            writer = writer.option("partitionOverwriteMode", "dynamic")  # partitions without new rows stay
        path = f"{self.root}/{name}"
        writer.parquet(path)
        self._views[name] = self.spark.read.option("mergeSchema", "true").parquet(path)
