"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Null text counts as empty. Rows that repeat an id, with the same text or another, are rows of their own. Further columns of any name
pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_place, likely, named_back, own_columns, table, without

#: Characters of the normalised text that the prefix hash covers.
PREFIX = 256


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space. Single spaces, most of all matches, are left alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}{{2,}}|[\x09-\x0D]", " ")


def _first(*cols: Column) -> list[Column]:
    """Columns to keep, and what the first two levels look at: length in bytes, hash of the first PREFIX characters."""
    norm = normalised(F.col("text"))
    return [*cols, F.octet_length(norm).alias("length"), F.xxhash64(F.left(norm, F.lit(PREFIX))).alias("prefix")]


def _digest() -> Column:
    return F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")


def _surviving(rows: DataFrame) -> DataFrame:
    """(length, prefix) of more than one row; what is alone with its length, or with its length and prefix, has no equal."""
    by_prefix = rows.groupBy("length", "prefix").agg(F.count("*").alias("n"))
    by_length = by_prefix.groupBy("length").agg(F.sum("n").alias("same_length")).where("same_length > 1").select("length")
    return by_prefix.where("n > 1").join(by_length, "length", "left_semi").select("length", "prefix")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id (the least id with an equal normalised text), group_size, digest.

    Three levels, each over the rows that the one before could not tell apart: length in bytes, hash of the
    first PREFIX characters, SHA-256 of the whole. Only narrow rows (id, length, hashes) are shuffled; the counts and minima
    are partial aggregates, and the one join by group has one row per group on its other side, so that
    adaptive execution can split a group that holds a third of all rows.
    The whole content has to be read for the digest of each row, so the one scan also yields the full hash; first_copies, which does
    without digests, hashes the surviving rows alone. Null ids are kept: keep_id is the least non-null id of the group, null if there is none.
    """
    narrow = own_columns(docs, id=id_col, text=text_col)
    rows = table(narrow.select(*_first(F.col("id")), _digest()), "signatures")
    left = rows.join(_surviving(rows), ["length", "prefix"], "left_semi")
    groups = left.groupBy("length", "digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    grouped = F.col("group_size").isNotNull()
    return rows.join(groups, ["length", "digest"], "left").select(
        "id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("digest")).alias("digest"),
    )


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal normalised texts: that of the least id, a null id last; of rows that share this id, the first by place.

    The same three levels. Rows are told apart by where they stand in their files, never by id. The second scan hashes the
    survivors alone, and their digests are shuffled, not their texts.
    """
    rows_of = by_place(docs)
    narrow = rows_of.select("_place", F.col(f"c{docs.columns.index(id_col)}").alias("id"), F.col(f"c{docs.columns.index(text_col)}").alias("text"))
    rows = table(narrow.select(*_first(F.col("_place"))), "signatures")
    survivors = table(rows.join(_surviving(rows), ["length", "prefix"], "left_semi").select("_place"), "survivors", small=True)
    # an inner join, as the optimizer would put a semi join below the digest and shuffle texts
    left = likely(narrow, survivors, ["_place"]).select("_place", "id", F.octet_length(normalised(F.col("text"))).alias("length"), _digest()).join(survivors, "_place")
    left = table(left, "digests", small=True)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_place").alias("at"))
    groups = left.groupBy("length", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("length", "digest", "first.at")
    dropped = table(left.join(groups, ["length", "digest"]).where(F.col("_place") != F.col("at")).select("_place"), "dropped", small=True)
    return named_back(without(rows_of, "_place", dropped), docs)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
