"""Merges without a table format: snapshots by rank, labelled outcomes, slowly changing dimensions, ledgers, outbox.

The merge order is (version, updated_at, event_id), null version as 0. A merge is a pure function of the stored
rows and the batch, so running it again, or on another order of rows, gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The outcomes of a merge.
OUTCOMES = ("INSERTED", "UPDATED", "DUPLICATE_IGNORED", "STALE_IGNORED")
#: Fixed value: the end of a version that is current.
OPEN_END = "9999-12-31 23:59:59.997"


def snapshot(stored: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key over stored and batch. Null-safe on keys; null order columns come first.

    One aggregate with map-side partial maxima: a key with a third of all rows is one row per task at the shuffle.
    """
    rows = batch if stored is None else stored.unionByName(batch, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def outcomes(batch: DataFrame, keys: list[str], order: list[str], arrival: str, stored: DataFrame | None = None) -> DataFrame:
    """batch with outcome, what merging row after row by arrival would have said of each.

    A row is compared with the greatest of the rows before it, the stored one first of all: a running maximum
    over the key's rows in order of arrival.
    """
    rank = F.struct(*order)
    rows = batch.withColumn("_stored", F.lit(False))
    if stored is not None:
        before = stored.withColumn("_stored", F.lit(True))
        rows = rows.unionByName(before, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.col("_stored").desc(), arrival).rowsBetween(W.unboundedPreceding, -1)
    seen = F.max(rank).over(w)
    rows = rows.withColumn("_seen", seen).withColumn("_rank", rank)
    label = F.when(F.col("_seen").isNull(), "INSERTED").when(F.col("_rank") > F.col("_seen"), "UPDATED").when(F.col("_rank") == F.col("_seen"), "DUPLICATE_IGNORED").otherwise("STALE_IGNORED")
    return rows.withColumn("outcome", label).where(~F.col("_stored")).drop("_stored", "_seen", "_rank")


def apply_if_newer(stored: DataFrame, batch: DataFrame, keys: list[str], seq: str, tie: list[Column], equal_wins: bool = False) -> DataFrame:
    """stored after batch: the batch's first row of a key by seq and tie replaces the stored one if its seq is greater, or equal where equal_wins."""
    w = W.partitionBy(*keys).orderBy(F.col(seq).desc(), *tie)
    new = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    both = new.withColumn("_new", F.lit(1)).unionByName(stored.withColumn("_new", F.lit(0)))
    first = F.col("_new").desc() if equal_wins else F.col("_new")
    w = W.partitionBy(*keys).orderBy(F.col(seq).desc(), first)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def scd2(dimension: DataFrame, incoming: DataFrame, key: str, record_hash: str, as_of: Column) -> DataFrame:
    """dimension (key, record_hash, ..., effective_from, effective_to, is_current) after incoming (key, record_hash, ...) at as_of.

    A current row whose hash differs is closed a millisecond before as_of; keys that are new or changed get a current row. One full
    outer join of the current rows with incoming decides all three; history passes by without a shuffle.
    """
    current, history = dimension.where("is_current"), dimension.where("not is_current")
    attributes = [c for c in incoming.columns if c != key]
    i = incoming.select(F.col(key).alias("_key"), F.struct(*attributes).alias("_in"))
    joined = current.join(i, current[key] == i["_key"], "full")
    here, there = F.col(key).isNotNull(), F.col("_key").isNotNull()
    changed = here & there & (F.col(record_hash) != F.col(f"_in.{record_hash}"))
    old = F.struct(
        F.col(key).alias(key), *[F.col(c).alias(c) for c in attributes], F.col("effective_from"),
        F.when(changed, as_of - F.expr("INTERVAL 1 MILLISECOND")).otherwise(F.col("effective_to")).alias("effective_to"), (~F.coalesce(changed, F.lit(False))).alias("is_current"))
    new = F.struct(
        F.col("_key").alias(key), *[F.col(f"_in.{c}").alias(c) for c in attributes], as_of.alias("effective_from"),
        F.lit(OPEN_END).cast(dimension.schema["effective_to"].dataType).alias("effective_to"), F.lit(True).alias("is_current"))
    rows = F.filter(F.array(F.when(here, old), F.when(there & (~here | F.coalesce(changed, F.lit(False))), new)), lambda x: x.isNotNull())
    made = joined.select(F.explode(rows).alias("r")).select("r.*")
    return history.select(*made.columns).unionByName(made)


def enqueue(outbox: DataFrame, events: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """The events to append: valid JSON, not in the outbox yet, one of each id."""
    fresh = events.where(F.try_parse_json(payload).isNotNull()).join(outbox.select(key), key, "left_anti")
    return fresh.dropDuplicates([key])


def claim(outbox: DataFrame, as_of: Column, max_rows: int = 1000, lease_seconds: int = 60, max_attempts: int = 10) -> DataFrame:
    """outbox with the first max_rows rows that are due claimed: READY, FAILED, or CLAIMED with a lapsed lease, attempts left.

    Ids of the claimed rows are bounded by max_rows, so that side is small by construction.
    """
    due = (F.col("status").isin("READY", "FAILED") | ((F.col("status") == "CLAIMED") & (F.col("lease_until") < as_of))) & (F.col("attempts") < max_attempts)
    ids = outbox.where(due).orderBy("outbox_event_id").limit(max_rows).select("outbox_event_id", F.lit(True).alias("_claimed"))
    rows = outbox.join(F.broadcast(ids), "outbox_event_id", "left")
    hit = F.col("_claimed").isNotNull()
    return rows.withColumns({
        "lease_until": F.when(hit, as_of + F.expr(f"INTERVAL {lease_seconds} SECONDS")).otherwise(F.col("lease_until")),
        "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "status": F.when(hit, "CLAIMED").otherwise(F.col("status")),
    }).drop("_claimed")


def acknowledge(outbox: DataFrame, published: DataFrame, token: str = "claim_token") -> DataFrame:
    """CLAIMED rows whose id and token are in published become PUBLISHED. Raises if published names a row that is not claimed with that token."""
    ok = outbox.where("status = 'CLAIMED'").join(published, ["outbox_event_id", token], "left_semi").select("outbox_event_id")
    if not published.join(ok, "outbox_event_id", "left_anti").isEmpty():
        raise ValueError("acknowledgement without a matching claim")
    done = ok.withColumn("_done", F.lit(True))
    return outbox.join(done, "outbox_event_id", "left").withColumn("status", F.when(F.col("_done"), "PUBLISHED").otherwise(F.col("status"))).drop("_done")


def release(outbox: DataFrame) -> DataFrame:
    """After an error: CLAIMED rows become FAILED, to be claimed again."""
    return outbox.withColumn("status", F.when(F.col("status") == "CLAIMED", "FAILED").otherwise(F.col("status")))


def ledger(stored: DataFrame | None, deliveries: DataFrame, keys: tuple[str, ...] = ("consumer", "event_id")) -> DataFrame:
    """(keys, first_seen, last_seen, delivery_count, is_duplicate) after deliveries (keys, seen_at)."""
    new = deliveries.groupBy(*keys).agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("delivery_count"))
    if stored is not None:
        new = stored.select(*new.columns).unionByName(new).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("delivery_count").alias("delivery_count"))
    return new.withColumn("is_duplicate", F.col("delivery_count") > 1)


def first_seen(ledger_rows: DataFrame, events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events whose id is in no ledger row, one of each."""
    return events.join(ledger_rows.select(key), key, "left_anti").dropDuplicates([key])


def route_deliveries(deliveries: DataFrame, ledger_rows: DataFrame, key: str = "event_id", arrival: str = "arrival", reason: str = "reason", attempts: str = "attempts", failed: str = "failed", max_attempts: int = 10) -> DataFrame:
    """deliveries with status and wait_seconds, the wait before a retry; attempts are those before this one.

    quarantine: reason is not null. duplicate_ignored: the ledger has the key, or an earlier delivery that passed its contract does. Of the
    others those that their handler failed go to retry, or to dead_letter when this was the last attempt; the rest is processed. The first delivery
    of a key is a minimum with partial aggregates, so that a key that is delivered over and over meets in no task.
    """
    from ..functions.scalars import backoff

    good = deliveries.where(F.col(reason).isNull())
    first = good.groupBy(key).agg(F.min(arrival).alias("_first")).join(ledger_rows.select(F.col(key), F.lit(True).alias("_seen")).distinct(), key, "left")
    rows = deliveries.join(first, key, "left")
    again = F.col("_seen").isNotNull() | (F.col(arrival) > F.col("_first"))
    lost = F.coalesce(F.col(failed), F.lit(False))
    status = F.when(F.col(reason).isNotNull(), "quarantine").when(again, "duplicate_ignored").when(~lost, "processed").when(F.col(attempts) + 1 >= max_attempts, "dead_letter").otherwise("retry")
    rows = rows.withColumn("status", status)
    return rows.withColumn("wait_seconds", F.when(F.col("status") == "retry", backoff(F.col(attempts) + 1))).drop("_first", "_seen")


def recompute_windows(mart: DataFrame, full: DataFrame, changed: DataFrame, keys: list[str], build) -> DataFrame:
    """mart after an incremental run: the windows that changed rows touch are built anew from all of full, the others stay.

    Replacing a window by an aggregate of its late rows alone would lose the early ones.
    """
    touched = changed.select(*keys).distinct()
    return mart.join(touched, keys, "left_anti").unionByName(build(full.join(touched, keys, "left_semi")).select(*mart.columns))
