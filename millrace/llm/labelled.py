"""Labelled samples of bounded size, and rows through Python with their ids kept exact; for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, own_columns


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5, held_out: int = 0, by_class: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, label, weight) of about rows labelled documents outside the held-out fold, chosen by a hash of the id.

    Nulls are no labels; a text that is null counts as empty. With by_class each class gives up to half of the rows, and weight says how many labelled rows one stands for.
    Only the labels are counted first; their sample, of bounded size, is what is broadcast to the documents.
    """
    known = own_columns(labels, id=id_col, label=label).where(F.col("id").isNotNull() & F.col("label").isNotNull() & (crc_mod("id", folds) != held_out))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if by_class:
        share = {k: min(1.0, rows / max(1, len(counts)) / n) for k, n in counts.items()}
    else:
        share = dict.fromkeys(counts, min(1.0, rows / max(1, sum(counts.values()))))
    chance = F.lit(0.0)
    for k, s in share.items():
        chance = F.when(F.col("label") == F.lit(k), F.lit(s)).otherwise(chance)
    key = F.xxhash64(F.lit("sample"), "id")
    picked = known.withColumn("key", key).withColumn("chance", chance).where(F.pmod("key", F.lit(1 << 30)) < F.col("chance") * (1 << 30))
    picked = picked.select("id", "key", F.col("label").cast("int").alias("label"), (1 / F.greatest("chance", F.lit(1e-9))).alias("weight"))
    texts = own_columns(docs, id=id_col, text=text_col)
    return texts.join(F.broadcast(picked), "id").select("key", F.coalesce("text", F.lit("")).alias("text"), "label", "weight")


def scored(docs: DataFrame, score: Callable[[list[str]], object], batch: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of docs; score takes a list of texts. Ids cross to pandas as text, so that nulls and long numbers stay exact."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at:at + batch]
                yield pd.DataFrame({"id": part["id"], "score": score(part["text"].tolist())})

    rows = own_columns(docs, id=id_col, text=text_col)
    text_id = F.coalesce(F.col("id").cast("string"), F.lit("\x00")).alias("id")
    made = rows.select(text_id, F.coalesce("text", F.lit("")).alias("text")).mapInPandas(through, "id string, score double")
    return made.withColumn("id", F.nullif("id", F.lit("\x00")).cast(kind))
