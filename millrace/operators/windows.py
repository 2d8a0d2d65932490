"""Event-time windows and temporal joins; the same functions serve batch and streaming frames."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """keys, window_start, window_end and measures; windows are closed below and open above."""
    return _windowed(df, F.window(ts, width), keys, measures)


def hopping(df: DataFrame, ts: str, width: str, hop: str, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """As tumbling, with windows that overlap: each row is expanded to width / hop windows and combined map-side before the shuffle."""
    return _windowed(df, F.window(ts, width, hop), keys, measures)


def hopping_totals(df: DataFrame, ts: str, width: int, hop: int, keys: list[str], distinct: str, sums: dict[str, Column]) -> DataFrame:
    """Hopping windows of whole seconds with event_count, distinct_count (of one column) and exact sums, where rows by window would be many.

    Rows are shuffled once, as they are, to blocks of 48 widths; only those in the first width of a block go to the block before as well.
    There a row is two changes: it enters at the first window that holds it and leaves after the last. A value enters or leaves with its
    row unless its next row is less than a width away. Totals run over the changes, and a stretch without changes is expanded to its
    windows last, so neither memory nor disk holds the rows times width / hop. The sums are worked out after the shuffle.
    """
    if width % hop:
        raise ValueError("the width has to be a multiple of the hop")
    n, step = width // hop, hop * 1_000_000
    long = 48 * n
    whole = lambda c, d: F.expr(f"({c} - pmod({c}, {d}L)) div {d}L")
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).where("_us is not null").withColumn("_pane", whole("_us", step))
    rows = rows.withColumn("_first", F.col("_pane") - (n - 1)).withColumn("_block", F.explode(F.sequence(whole("_first", long), whole("_pane", long))))
    rows = rows.drop(ts, "_us", "_first").repartition(*keys, "_block")
    order = W.partitionBy(*keys, "_block", distinct).orderBy("_pane")
    near = lambda other: F.col(distinct).isNull() | F.coalesce(F.abs(other - F.col("_pane")) < n, F.lit(False))
    rows = rows.withColumn("_in", F.when(near(F.lag("_pane").over(order)), 0).otherwise(1)).withColumn("_out", F.when(near(F.lead("_pane").over(order)), 0).otherwise(-1))
    rows = rows.select(*keys, "_block", *[c.alias(name) for name, c in sums.items()], F.inline(F.array(
        F.struct((F.col("_pane") - (n - 1)).alias("_w"), F.lit(1).alias("_sign"), F.col("_in").alias("_value")),
        F.struct((F.col("_pane") + 1).alias("_w"), F.lit(-1).alias("_sign"), F.col("_out").alias("_value")))))
    to = W.partitionBy(*keys, "_block").orderBy("_w")  # with its peers: the last of these has the total
    total = lambda c: F.sum(F.when(F.col("_sign") > 0, c).otherwise(-c)).over(to)
    sum_ = lambda c: F.when(F.sum(F.when(F.col(c).isNotNull(), F.col("_sign"))).over(to) > 0, total(F.col(c)))  # noqa: E731  # null where all are
    out = rows.select(*keys, F.greatest("_w", F.col("_block") * long).alias("_from"), (F.least(F.lead("_w").over(to), (F.col("_block") + 1) * long) - 1).alias("_to"),
                      F.sum("_sign").over(to).alias("event_count"), F.sum("_value").over(to).alias("distinct_count"), *[sum_(c).alias(c) for c in sums])
    out = out.where("event_count > 0 and _from <= _to").withColumn("_w", F.explode(F.sequence("_from", "_to")))
    at = lambda w: F.timestamp_micros(w * step)
    return out.select(*keys, at(F.col("_w")).alias("window_start"), at(F.col("_w") + n).alias("window_end"), "event_count", "distinct_count", *sums)


def _windowed(df: DataFrame, window: Column, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    out = df.groupBy(*keys, window.alias("w")).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *measures)


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Sessions by gap: an event exactly the gap after the one before still joins; session_end is the last event plus the gap."""
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *measures)


def capped_sessions(df: DataFrame, ts: str, gap_seconds: int, cap_seconds: int, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Sessions by gap that last cap_seconds at most: within one, every cap_seconds from its start begin a new one.

    Two windows over the same partitioning and no Python: the first finds where gaps begin sessions, the second numbers
    them; the cap is arithmetic on the distance from a session's first event.
    """
    # whole microseconds, so that the distance to the cap is exact
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    order = W.partitionBy(*keys).orderBy("_us")
    rows = df.withColumn("_us", micros)
    opens = F.when((F.col("_us") - F.lag("_us").over(order)) <= gap_seconds * 1_000_000, 0).otherwise(1)
    rows = rows.withColumn("_open", opens).withColumn("_session", F.sum("_open").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min("_us").over(W.partitionBy(*keys, "_session"))
    rows = rows.withColumn("_piece", F.floor((F.col("_us") - first) / (cap_seconds * 1_000_000)))
    out = rows.groupBy(*keys, "_session", "_piece").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), *[m.alias(n) for n, m in measures.items()])
    return out.drop("_session", "_piece")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, within: str) -> DataFrame:
    """Inner join on keys where right_ts is at left_ts or up to within later, elapsed time; right's other columns must not clash with left's.

    On batch frames the equal keys drive the shuffle. Streaming frames need watermarks on both times, which then bound the state.
    """
    l, r = left.alias("l"), right.alias("r")
    same = F.lit(True)
    for k in on:
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    near = F.col(f"r.{right_ts}").between(F.col(f"l.{left_ts}"), F.col(f"l.{left_ts}") + F.expr(f"INTERVAL {within}"))
    return l.join(r, same & near).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in on])


def bucketed_interval_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """interval_join for few, hot keys: time in buckets of that many seconds is part of the join key, and the left
    side goes to two buckets, so a key's rows are spread over its time instead of meeting in one task."""
    at = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    l = left.withColumn("_bucket", F.explode(F.array(at(left_ts), at(left_ts) + 1)))
    r = right.withColumn("_bucket", at(right_ts))
    return interval_join(l, r, [*on, "_bucket"], left_ts, right_ts, f"{seconds} SECONDS").drop("_bucket")


def latest_per_window(df: DataFrame, ts: str, width: str, keys: list[str], tie: str) -> DataFrame:
    """The last event of each key in each window, by event time, then tie: an argmax with partial aggregates."""
    row = F.struct(*df.columns)
    out = df.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.max_by(row, F.struct(ts, tie)).alias("row"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "row.*")


class CappedSessionProcessor:
    """Capped sessions in a stream by the rule of capped_sessions, for applyInPandasWithState.

    State (STATE), in microseconds: the session's first event, the current piece's start, last event and count, -1 where there is none, and the
    events that the watermark has not passed. These wait, so that events are taken in order of their time in whatever batches they come.
    """

    STATE = "first long, start long, last long, n long, waiting array<long>"
    OUTPUT = "key string, session_start timestamp, session_end timestamp, event_count long"

    def __init__(self, gap_seconds: int, cap_seconds: int):
        self.gap, self.cap = gap_seconds * 1_000_000, cap_seconds * 1_000_000

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, start, last, n, waiting = state.get if state.exists else (-1, -1, -1, 0, [])
        waiting = sorted([*waiting, *(t for b in batches for t in b["ts"].astype("datetime64[us]").astype("int64").tolist())])
        mark, closed = state.getCurrentWatermarkMs() * 1_000, []
        passed = bisect_right(waiting, mark)
        for t in waiting[:passed]:
            joins = n > 0 and t - last <= self.gap
            if n and not (joins and (t - first) // self.cap == (start - first) // self.cap):
                closed.append((start, last, n))
                n = 0
            if not n:
                first, start = first if joins else t, t
            last, n = t, n + 1
        waiting = waiting[passed:]
        if n and last + self.gap < mark:
            closed.append((start, last, n))
            first, start, last, n = -1, -1, -1, 0
        if n or waiting:
            state.update((first, start, last, n, waiting))
            due = min([*waiting[:1], *([last + self.gap] if n else [])])
            state.setTimeoutTimestamp(max(due, mark) // 1_000 + 1)
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame([(*key, pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us"), c) for a, b, c in closed], columns=["key", "session_start", "session_end", "event_count"])
