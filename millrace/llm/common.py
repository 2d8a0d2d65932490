"""What several operators of this folder share: scratch tables, running totals, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: ASCII white space, as every contract of this folder has it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting while a table is written: nothing else reads the write's shuffles, so their files go when it ends and not when
#: the driver collects garbage.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Whole texts cross to Python in batches of so many bytes, and not of so many rows, whatever their length.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: Buckets of the filter that spares texts a shuffle: a broadcast of at most so many numbers.
FILTER_BUCKETS = 1 << 20
#: Rows of two numbers that one task writes with ease.
FEW = 200_000

_own_dir: list[str] = []
#: The folders of scratch tables of each scope that is open.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); one of our own only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def table(df: DataFrame, name: str, small: bool = False, kept: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, so that a lost
    executor costs no more than the tasks that read its part, and keeps narrow columns compressed.

    With small, what many tasks have a few rows of each is rebalanced to files of the advisory size first. With kept, the table outlives
    the scope it is written in.
    """
    df = df.hint("rebalance") if small else df
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    for scope in _scopes[-1:] if not kept else ():
        scope.append(folder)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Holds batches to Python at BATCH_BYTES for the session, as a lazy result crosses when its reader asks for it; a smaller setting stays."""
    now = str(spark.conf.get(BATCH_SETTING)).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def _delete(spark: SparkSession, folders: set[str] | list[str]) -> None:
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    _delete(spark, {f.rpartition("/")[0] for f in df.inputFiles()})


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """The scratch tables written within are deleted at its end: for callers that have written their result elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def settled(docs: DataFrame) -> DataFrame:
    """docs as rows of Parquet files, which place() tells apart: docs itself where it is a plain scan of such files, else a table written of it."""
    node = docs._jdf.queryExecution().analyzed()
    kind = lambda n: n.getClass().getSimpleName()
    while kind(node) in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    if kind(node) == "LogicalRelation" and kind(node.relation()) == "HadoopFsRelation" and "Parquet" in kind(node.relation().fileFormat()):
        return docs
    return table(docs, "settled")


def place(docs: DataFrame) -> Column:
    """Where a row of settled docs stands: (hash of the file's path, row of the file). No two rows have the same, whatever they hold, and it is the same at each scan."""
    m = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(m["file_path"]).alias("file"), m["row_index"].alias("at"))


def without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose key is not in dropped, a written table with that one column.

    Only rows in a hash bucket of dropped can be in it: the others pass by without a shuffle, unless dropped is so
    small that it is broadcast by its known size.
    """
    spark = docs.sparkSession
    if sum(1 for _ in dropped.inputFiles()) and dropped._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return docs.join(dropped, key, "left_anti")
    bucket = F.pmod(F.xxhash64(key), F.lit(FILTER_BUCKETS))
    taken = dropped.select(bucket.alias("_bucket")).distinct().withColumn("_taken", F.lit(True))
    marked = docs.withColumn("_bucket", bucket).join(F.broadcast(taken), "_bucket", "left").drop("_bucket")
    sure, open_ = marked.where("_taken is null").drop("_taken"), marked.where("_taken").drop("_taken")
    return sure.union(open_.join(dropped, key, "left_anti").select(*sure.columns))


def by_place(docs: DataFrame) -> DataFrame:
    """settled docs under names by position (c0, c1, ...), so that no name of docs clashes with one of ours, with _place."""
    docs = settled(docs)
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], place(docs).alias("_place"))


def named_back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """What by_place(docs) has become, under the names of docs."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def own_columns(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under fixed names of ours, so that further columns of df, whatever they are called, cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(new) for new, c in names.items()])


def uniform_key(*cols: Column) -> Column:
    """31 bits, uniform over distinct values of cols; the same in any SQL that has md5."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 1)


def running_total(df: DataFrame, group: list[str], key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before this one in its group, by key and then order.

    key holds uniform 31-bit numbers. Each group is range-sorted into about sqrt(rows) ranges of key; the ranges'
    totals are summed first (with map-side partial sums), then rows within a range. So no task holds
    more than the rows of a few ranges, however large one group is. Columns of group must not be null;
    df should be a written table, as it is read three times.
    """
    ranges = max(1, int(df.count() ** 0.5))
    df = df.withColumn("_range", F.floor(F.col(key) * F.lit(ranges) / F.lit(float(1 << 31))).cast("long"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        df.groupBy(*group, "_range").agg(F.sum(value).alias("_in_range"))
        .withColumn("_start", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
        .drop("_in_range")
    )
    within = W.partitionBy(*group, "_range").orderBy(key, *order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.join(starts, [*group, "_range"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_range", "_start")
    )


def _joined(edges: DataFrame) -> DataFrame:
    """components of few edges (hi, lo): one task joins them up in memory, as the rounds of jobs below cost the driver more than the edges are."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["hi"].tolist(), batch["lo"].tolist(), strict=True):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        yield pd.DataFrame({"id": list(above), "root": [root(x) for x in above]}, dtype="int64")

    return table(edges.coalesce(1).mapInPandas(join, "id long, root long"), "roots")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(id, root): root is the smallest id that the undirected edges (a, b), longs, of a written table lead to from id. Ids in no edge with another are not returned.

    Alternating large-star and small-star steps: the number of edges does not grow, and about log(vertices) steps
    suffice. A hub's neighbours need not meet in one task: its minimum is a partial aggregate, and the edges get it by a join
    that adaptive execution can split. Each step is written to the shared folder, so that its loss costs that step alone.
    Up to few edges are joined up by one task instead.
    """
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        """What changes when the rows, all different, do: sums of ids would overflow."""
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())

    def step(df: DataFrame, rows: int) -> DataFrame:
        """At most so many rows, written by a task for each FEW of them."""
        return table(df.distinct().coalesce(1 + rows // FEW), "edges")

    current = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo")
    rows = current.count()
    if rows <= few:
        return _joined(current)
    current = step(current, rows)
    before = mark(current)
    while True:
        up, down = current.select(F.col("lo").alias("u"), F.col("hi").alias("v")), current.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        # large star: the neighbours above u go to the least of u and its neighbours
        large = step(up.join(least, "u", "left").select(F.col("v").alias("hi"), F.coalesce("m", "u").alias("lo")), before[0])
        drop_table(spark, current)
        # small star: u and its neighbours below go to the least of these
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        current = step(moved.union(low.select("hi", F.col("m").alias("lo"))), 2 * before[0])
        drop_table(spark, large)
        after = mark(current)
        if after == before:
            roots = current.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
            return roots.union(current.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
        before = after


def trim() -> None:
    """Gives memory that Python and Arrow have freed back to the system; for the end of a task's work in a worker that lives on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # a C library without it


def likely(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys may be in wanted, without a shuffle of df: those in the same hash bucket as a row of wanted.

    What is broadcast is bounded by FILTER_BUCKETS however large wanted is; the more of the buckets are taken, the less
    is left out. An exact join has to follow.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BUCKETS)).alias("_bucket")
    taken = wanted.select(bucket).distinct()
    return df.withColumn("_bucket", bucket).join(F.broadcast(taken), "_bucket", "left_semi").drop("_bucket")


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; the held-out split of the contracts. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))
