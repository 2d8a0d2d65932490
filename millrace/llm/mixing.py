"""Mixing sources to target weights by hash-random keys and distributed prefix sums. DataFrame functions only.

Null text has size 0. Null sources form a source of their own, the last. Rows that repeat an id are
further documents. An empty table gives an empty mix; a document of size 0 is taken 0 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, by_place, named_back, own_columns, running_total, table, uniform_key

#: Fixed value: the sources' weights in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Fixed value: epochs at most.
EPOCHS = 3


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """totals (source, source_size), one row per source, with target.

    Sharing the excess of capped sources by weight until none is above its cap ends where target =
    min(cap, weight * level), with one level for all. By rising cap / weight, the capped sources come first,
    so that the level follows from sums over what comes before. The windows order all
    sources in one task: one narrow row per source, never a row per document.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1))
    t = t.withColumn("cap", (F.col("source_size") * epochs).cast("long"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    t = t.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # the first source that is not capped has the level of all others like it
    t = t.withColumn("place", F.row_number().over(order))
    level = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("shared"))
    return t.withColumn("shared", level).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, taken for each row of docs; taken: words of it in the mix, with repeats.

    The documents of a source stand in the order of a random key (hash of seed and id, then id, then the text's hash). Its budget, target
    rounded down, goes round that order: whole epochs take all, the last takes documents up to the budget and cuts the one that
    crosses it, so each source gives exactly its budget. The order is range-sorted and summed by
    running_total, so a source with a third of all rows is spread over many tasks.
    """
    return _placed(own_columns(docs, id=id_col, text=text_col, source=source_col), weights, epochs, seed)


def _placed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 42, kept: tuple[str, ...] = ()) -> DataFrame:
    """mix of (id, text, source), with further columns kept."""
    rows = table(
        docs.select(
            "id", "source", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source")).alias("of"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            uniform_key(F.lit(seed), F.col("id")).alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"), *kept,
        ), "sizes")
    totals = rows.groupBy("source", "of").agg(F.sum("size").alias("source_size"))
    goals = targets(totals.drop("of"), weights, epochs)
    goals = goals.withColumn("of", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))).drop("source")
    placed = running_total(rows, ["of"], "key", ["id", "tie", *kept], "size", "before").join(goals, "of")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("before")))
    return placed.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *kept)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that mix takes, as often as it takes them, with the last copy cut after the last word that is taken.

    A document of no words is in no budget; it is left out, as it has nothing to give. Rows are told apart by where they stand in their
    files, so that null and repeated ids are rows like others. Further columns of any name pass through.
    """
    rows = by_place(docs)
    doc_id, text, source = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col, source_col))
    placed = _placed(rows.select(doc_id.alias("id"), text.alias("text"), source.alias("source"), "_place"), weights, epochs, seed, kept=("_place",))
    chosen = placed.where("taken > 0").select("_place", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    words = F.transform(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int")), lambda i: F.least("_size", F.col("_taken") - (i - 1) * F.col("_size")))
    out = rows.join(chosen, "_place").withColumn("_words", F.explode(words))
    # a word with the white space before it, so many times: what is kept stays as it was
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"{SPACE}*+{WORD}"), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    name = f"c{docs.columns.index(text_col)}"
    return named_back(out.withColumn(name, F.when(F.col("_words") < F.col("_size"), cut).otherwise(text)), docs)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('42' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), chr(0))) AS digest, md5(coalesce(text, '')) AS tie FROM documents),
k AS (SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) >> 1 AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM o) - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN CAST(cap AS DOUBLE)
         ELSE weight * (SELECT arg_min(level, place) FROM l WHERE cap > weight * level) END AS target FROM l),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
b AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken FROM b
"""
