"""Relational helpers: profiles, duplicates, gaps, ranking, reconciliation, checksums, drift, quantiles."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def profile(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counts and measures by keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), *[m.alias(n) for n, m in measures.items()])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def sequence_gaps(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Numbers missing between the least and the greatest of a sequence."""
    return df.groupBy(*by).agg((F.max(seq) - F.min(seq) + 1 - F.countDistinct(seq)).alias("estimated_gap"))


def diagnostics(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(entity, violations) of each named frame: one conditional count each, no rows moved."""
    parts = [df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("violations")).select(F.lit(n).alias("entity"), "violations") for n, (df, bad) in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order, by a window: for orders that latest_by cannot express. All rows of a key are sorted in one task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order columns, by a map-side combined aggregate rather than a sort; rows that tie on all of these are told apart by the other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.max(row).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Takes k in each task first; no global sort."""
    return df.orderBy(*order).limit(k)


def reconcile(source: DataFrame, target: DataFrame, amount: str, explained_count: int = 0, explained_amount: float = 0) -> DataFrame:
    """One row: counts, amounts, what is left unexplained, and whether nothing is."""
    one = lambda df, side: df.agg(F.count("*").alias(f"{side}_count"), F.coalesce(F.sum(amount), F.lit(0).cast("decimal(18,2)")).alias(f"{side}_amount"))
    both = one(source, "source").crossJoin(one(target, "target"))  # one row each
    count = F.col("source_count") - F.col("target_count") - F.lit(explained_count)
    value = F.col("source_amount") - F.col("target_amount") - F.lit(explained_amount).cast("decimal(18,2)")
    return both.withColumns({"unexplained_count_delta": count, "unexplained_amount_delta": value}).withColumn("balanced", (F.col("unexplained_count_delta") == 0) & (F.col("unexplained_amount_delta") == 0))


def assert_balanced(result: DataFrame) -> None:
    """Raises if a reconciliation has an unexplained variance."""
    row = result.first()
    if not row["balanced"]:
        raise ValueError(f"reconciliation variance: {row.asDict()}")


def outcome_balance(df: DataFrame, outcome: str, outcomes: Iterable[str]) -> DataFrame:
    """One row: source count, a count of each outcome, and source less their sum."""
    names = list(outcomes)
    counted = df.agg(F.count("*").alias("source"), *[F.count_if(F.col(outcome) == n).alias(n) for n in names])
    return counted.withColumn("unexplained", F.col("source") - reduce(lambda a, b: a + b, [F.col(n) for n in names]))


def checksum(df: DataFrame, keys: list[str]) -> DataFrame:
    """(row_count, checksum): independent of order and partitioning, and the same for the same bag of keys.

    Sum of 32-bit pieces of each row's MD5: sums combine map-side, where a sorted concatenation would gather all rows in one task.
    """
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    piece = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    sums = [F.sum(piece(i)).alias(f"s{i}") for i in range(4)]
    return df.agg(F.count("*").alias("row_count"), *sums).select("row_count", F.concat_ws("-", *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)]).alias("checksum"))


#: Cells that a histogram pass divides a range into.
CELLS = 4_096


def finite(df: DataFrame, value: str) -> DataFrame:
    """One column x, double: the finite numbers of a column."""
    x = F.col(value).cast("double")
    return df.select(x.alias("x")).where(F.abs("x") < float("inf"))


def order_statistics(df: DataFrame, value: str, ranks: Iterable[int]) -> list[float]:
    """The values at these ranks, from 0, of the finite numbers of a column. Exact, without a sort or a map of all values.

    A pass counts values by CELLS cells of each range that a rank is known to lie in; the cell that holds the rank is the next range, from its least
    to its greatest value. A range of one value is the answer: two or three passes mostly, each with partial aggregates of bounded size.
    """
    rows = finite(df, value)
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    open_ = {r: (low, high, r) for r in set(ranks)}
    found = {r: low for r in open_ if low == high}
    while len(found) < len(open_):
        ranges = sorted({open_[r][:2] for r in open_ if r not in found})
        half = lambda a, b: 1.0 if math.isfinite(b - a) else 0.5  # so that no width overflows, nor vanishes
        cell = lambda a, b: F.least(F.lit(CELLS - 1), F.floor((F.col("x") * half(a, b) - a * half(a, b)) / (b * half(a, b) - a * half(a, b)) * CELLS))
        places = F.array(*[F.when(F.col("x").between(a, b), F.struct(F.lit(i).alias("range"), cell(a, b).cast("int").alias("cell"))) for i, (a, b) in enumerate(ranges)])
        cells = rows.select("x", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        counted: dict[int, list] = {}
        for r in sorted(cells.collect(), key=lambda r: (r["p"]["range"], r["p"]["cell"])):
            counted.setdefault(r["p"]["range"], []).append(r)
        for rank, (a, b, left) in list(open_.items()):
            if rank in found:
                continue
            for r in counted[ranges.index((a, b))]:
                if left < r["n"]:
                    break
                left -= r["n"]
            open_[rank] = (r["a"], r["b"], left)
            if r["a"] == r["b"]:
                found[rank] = r["a"]
    return [found[r] for r in ranks]


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Inclusive percentiles, interpolated between neighbouring ranks; none without values."""
    m = finite(df, value).count()
    if not m:
        return []
    spots = [s * (m - 1) for s in shares]
    at = order_statistics(df, value, [k for s in spots for k in (int(s), min(int(s) + 1, m - 1))])
    return [low + (high - low) * (s - int(s)) for s, low, high in zip(spots, at[::2], at[1::2], strict=True)]


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(psi) of current against bins at the exact quantiles of reference; null values are left out.

    The edges, at most bins + 1 numbers, come to the driver; both histograms are partial aggregates. Bins are closed below, the last one
    at both ends; what lies outside is dropped. Without values on a side it is infinite, with fewer than three edges 0.
    """
    edges = sorted(set(percentiles(reference, value, [i / bins for i in range(bins + 1)])))
    spark = reference.sparkSession
    if not edges or current.where(F.col(value).isNotNull()).isEmpty():
        return spark.range(1).select(F.lit(float("inf")).alias("psi"))
    if len(edges) < 3:
        return spark.range(1).select(F.lit(0.0).alias("psi"))
    x = F.col(value).cast("double")
    place = F.lit(0)
    for i, edge in enumerate(edges[1:-1], 1):
        place = F.when(x >= edge, F.lit(i)).otherwise(place)
    inside = lambda df, side: df.where(x.between(edges[0], edges[-1])).select(place.alias("bin"), F.lit(side).alias("side"))
    counts = inside(reference, 0).unionByName(inside(current, 1)).groupBy("bin").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    every = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    counts = every.join(counts, "bin", "left").fillna(0)
    total = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # over bins, a handful of rows
    share = lambda c: F.greatest(F.col(c) / F.greatest(F.sum(c).over(total), F.lit(1)), F.lit(1e-6))
    shares = counts.select(share("r").alias("r"), share("c").alias("c"))
    return shares.agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"))


def exclusive_quantile(df: DataFrame, value: str, i: int, n: int) -> DataFrame:
    """The i-th of n exclusive quantiles, at rank i (m + 1) / n, as one row: two exact order statistics, and no list of values."""
    m = finite(df, value).count()
    if m < 2:
        return finite(df, value).agg(F.max("x").alias("quantile"))
    rank = min(max(i * (m + 1) // n, 1), m - 1)
    part = i * (m + 1) - rank * n
    low, high = order_statistics(df, value, [rank - 1, rank])
    return df.sparkSession.range(1).select(F.lit((low * (n - part) + high * part) / n).alias("quantile"))


def dependencies_complete(items: DataFrame, key: str, dependencies: str, status: str, done: str = "COMPLETE") -> DataFrame:
    """items with ready: every id in the array dependencies is there with status done; none is ready too."""
    open_ = items.select(F.col(key).alias("_key"), F.explode(dependencies).alias("_needs"))
    complete = items.where(F.col(status) == done).select(F.col(key).alias("_needs"))
    blocked = open_.join(complete, "_needs", "left_anti").select(F.col("_key").alias(key)).distinct().withColumn("_blocked", F.lit(True))
    return items.join(blocked, key, "left").withColumn("ready", F.col("_blocked").isNull()).drop("_blocked")


def not_null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")
