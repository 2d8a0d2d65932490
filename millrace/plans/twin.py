"""The operations twin: scenarios simulated side by side, and the guest-value model.

A run is rows: scenario, seed, hour, and draw. Each draw is a hash of (seed, hour, stream, number), so scenarios with the same seed meet the same
chance, hours are spread over tasks, and nothing depends on the order in which draws are made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import percentiles

#: A scenario's fields with their defaults.
SCENARIO = {
    "reservations_per_hour": 120, "gaming_sessions_per_hour": 900, "mobile_events_per_hour": 5000,
    "hotel_latency": 240.0, "gaming_latency": 45.0, "offer_lift": 0.0, "outage_minutes": 0,
}
#: Rate, relative spread of the hourly volume.
VOLUMES = {"reservations": ("reservations_per_hour", 0.12), "gaming_sessions": ("gaming_sessions_per_hour", 0.15), "mobile_events": ("mobile_events_per_hour", 0.18)}
#: What is measured, its typical latency, its spread, and how many an hour at most.
LATENCIES = {"reservations": ("hotel_latency", 0.25, 1 << 30), "gaming_sessions": ("gaming_latency", 0.20, 1000)}
#: The least latency; responses per mobile event; share of events lost in an outage; factors, floors and lift of modernisation.
LEAST_LATENCY, RESPONSE_RATE, LOSS_RATE = 0.01, 0.01, 0.002
MODERN = {"hotel_latency": (0.45, 30.0), "gaming_latency": (0.35, 5.0)}
MODERN_LIFT, MODERN_NAME = 0.12, "-cloud-modernized"


def scenarios(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Scenarios by name; fields that a row lacks have their default."""
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in SCENARIO.items())
    return spark.createDataFrame([(r["name"], *[type(v)(r.get(k, v)) for k, v in SCENARIO.items()]) for r in rows], f"name string, {kinds}")


def modernised(df: DataFrame) -> DataFrame:
    """The scenarios after modernisation: latencies shorter by a factor, down to a floor, and a higher response."""
    shorter = {c: F.greatest(F.lit(floor), F.col(c) * factor) for c, (factor, floor) in MODERN.items()}
    return df.withColumns({**shorter, "offer_lift": F.col("offer_lift") + MODERN_LIFT, "name": F.concat("name", F.lit(MODERN_NAME))})


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from the key's hash."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + 0.5) / float(1 << 53)


def normal(*key: Column) -> Column:
    """A standard normal draw from two uniform ones."""
    radius = F.sqrt(-2 * F.ln(uniform(F.lit("radius"), *key)))
    return radius * F.cos(2 * math.pi * uniform(F.lit("angle"), *key))


def hours_of(df: DataFrame, hours: int, seeds: tuple[int, ...]) -> DataFrame:
    """A row for each scenario, seed and hour, with the hour's volumes."""
    runs = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    volumes = {name: F.greatest(F.lit(0), F.floor(F.col(rate) * (1 + spread * normal(F.col("seed"), F.col("hour"), F.lit(name))))) for name, (rate, spread) in VOLUMES.items()}
    return runs.withColumns(volumes)


def latencies_of(hourly: DataFrame) -> DataFrame:
    """(name, seed, latency), a row for each measured event."""
    kinds = [F.struct(F.lit(k).alias("stream"), F.least(F.col(k), F.lit(most)).cast("int").alias("n"), F.col(base).alias("base"), F.lit(spread).alias("spread")) for k, (base, spread, most) in LATENCIES.items()]
    each = hourly.select("name", "seed", "hour", F.explode(F.array(*kinds)).alias("k")).where("k.n > 0")
    each = each.select("name", "seed", "hour", "k.*").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("n"))))
    z = normal(F.col("seed"), F.col("hour"), F.col("stream"), F.col("draw"))
    return each.select("name", "seed", F.greatest(F.lit(LEAST_LATENCY), F.col("base") * F.exp(F.col("spread") * z)).alias("latency"))


def simulate(df: DataFrame, hours: int = 24, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """A row for each scenario and seed: volumes, mean and p95 of latency (a mergeable sketch, to a ten-thousandth of the ranks), responses and lost events."""
    hourly = hours_of(df, hours, seeds)
    responses = F.floor(F.col("mobile_events") * RESPONSE_RATE * (1 + F.col("offer_lift")))
    totals = hourly.groupBy("name", "seed").agg(*[F.sum(v).alias(v) for v in VOLUMES], F.sum(responses).alias("offer_responses"), F.max("outage_minutes").alias("_out"))
    lost = (F.col("reservations") + F.col("gaming_sessions") + F.col("mobile_events")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_out") / (60.0 * hours))) * LOSS_RATE
    stats = latencies_of(hourly).groupBy("name", "seed").agg(F.avg("latency").alias("mean_latency"), F.percentile_approx("latency", 0.95, 10_000).alias("p95_latency"))
    joined = totals.join(stats, ["name", "seed"], "left").fillna(0.0, ["mean_latency", "p95_latency"])
    return joined.select("name", "seed", *VOLUMES, "mean_latency", "p95_latency", "offer_responses", F.floor(lost).alias("lost_events"))


def paired(baseline: DataFrame, candidate: DataFrame, hours: int = 24, seed: int = 42) -> DataFrame:
    """One row for a baseline and a candidate of a scenario each: gain in p95 latency in percent, responses won, change in lost events."""
    sides = baseline.withColumn("_side", F.lit("b")).unionByName(candidate.withColumn("_side", F.lit("c")))
    runs = simulate(sides.withColumn("name", F.concat("_side", F.lit(":"), "name")), hours, (seed,)).withColumn("_side", F.left("name", F.lit(1)))
    of = lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    gain = 100 * (of("b", "p95_latency") - of("c", "p95_latency")) / F.greatest(of("b", "p95_latency"), F.lit(1e-9))
    change = lambda c: of("c", c) - of("b", c)
    return runs.agg(F.round(gain, 2).alias("latency_improvement_pct"), change("offer_responses").alias("additional_offer_responses"), change("lost_events").alias("lost_event_delta"))


def train_value_model(features: DataFrame, columns: list[str], target: str, time_column: str, share: float = 0.8, seed: int = 7, rounds: int = 250, step: float = 0.05, depth: int = 5):
    """(model, mae, r2): boosted trees on scaled features, trained on the first share of time and measured on the rest. A feature that is null counts as 0.

    Trees are bounded by their depth (5: at most 32 leaves), as Spark has no bound on leaves.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    features = features.fillna(0, columns)
    cut = percentiles(features, time_column, [share])[0]
    early = F.col(time_column).cast("double") <= F.lit(cut)
    steps = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="error"), StandardScaler(inputCol="raw", outputCol="features"), GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)]
    model = Pipeline(stages=steps).fit(features.where(early))
    scored = model.transform(features.where(~early))
    measure = lambda m: RegressionEvaluator(labelCol=target, metricName=m).evaluate(scored)
    return model, measure("mae"), measure("r2")
