"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, jaccard, language, mixing, packing
from millrace.llm.common import drop_table, scratch_scope, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language go; the parser learns from the documents' own labels."""
    return language.in_a_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the least doc_id."""
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of each group the document with the least doc_id stays.

    At 0.8 a bound needs twice the partitions that it needs at 0.9; with one part each there is one signature a partition.
    """
    return jaccard.first_of_groups(docs, words=5, percent=80, parts=1, differ=0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    return packing.pack(docs, packing.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: None: SQL cannot express language ID, PartEnum's hashing of Python words, tokenising or minimum bin slack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, as a written table; the tables between are deleted as soon as they have been read."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), False
    for name, stage in STAGES:
        with scratch_scope(spark):
            made = table(stage(spark, docs, sf_dir), name, kept=True)
        if read:
            drop_table(spark, docs)
        docs, read = made, True
    return docs
