"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Null and empty texts have no n-grams; their score is the model's base rate. Labels that are null, or whose document is
missing, are left out; without labels of both classes each score is the mean label, 0 without any. Rows that repeat an id are
scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, table
from .labelled import sample, scored

#: Characters of an n-gram, and bits of the table they are hashed to.
ORDERS, BITS = (3, 4, 5), 19
#: The classifier's bound: labelled rows it is fitted on, about, half of each class.
SAMPLE = 8_000
#: Features in as many sampled texts at least, and so many of them, those that tell the classes apart best.
LEAST_TEXTS, FEATURES = 5, 5_000
#: A feature's value is the logarithm of one more than its occurrences in so many characters; so many are added to a text's length, lest one in a short text weighs all.
PER, LENGTH_PRIOR = 1_000, 50
#: Texts at a time.
BATCH = 200
CUT = 0.5


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all n-grams of the lower-cased texts, with a space before and after, blanks collapsed."""
    folded = [" " + " ".join(t.lower().split()) + " " for t in texts]
    flat = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in folded])
    buckets, owners, h = [], [], flat
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + flat[n - 1:]
        if n in ORDERS and len(h):
            same = owner[: len(h)] == owner[n - 1:]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            buckets.append(((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))[same])
            owners.append(owner[: len(h)][same])
    return (np.concatenate(owners), np.concatenate(buckets).astype(np.int64)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def present(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different (text, bucket)."""
    owner, bucket = grams(texts)
    key = np.unique(owner << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def densities(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the wanted buckets: how densely a text has a feature, as a long text has nearly all of them somewhere."""
    owner, bucket = grams(texts)
    length = np.bincount(owner, minlength=len(texts)) / len(ORDERS)
    keep = wanted[bucket]
    key, n = np.unique(owner[keep] << BITS | bucket[keep], return_counts=True)
    owner = key >> BITS
    return owner, key & ((1 << BITS) - 1), np.log1p(PER * n / (length[owner] + LENGTH_PRIOR))


class Model:
    """Weights by bucket, the log-count ratio of a feature times its learned weight, and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.wanted = weights != 0

    def probability(self, texts: list[str]) -> np.ndarray:
        owner, bucket, value = densities(texts, self.wanted)
        logit = self.intercept + np.bincount(owner, value * self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def log_count_ratios(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [class, bucket] of texts with a feature: the naive Bayes ratio of each bucket, and which buckets are features."""
    smooth = counts + 1.0
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    both = counts.sum(axis=0)
    worth = np.where(both >= LEAST_TEXTS, np.abs(ratio) * np.sqrt(both), 0.0)
    cut = np.partition(worth, -FEATURES)[-FEATURES] if len(worth) > FEATURES else 0.0
    return ratio, (worth > 0) & (worth >= cut)


def regress(owner: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, columns: int, l2: float = 2e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by full-batch Adam: weights and intercept."""
    w, b = np.ones(columns) * 0.01, 0.0
    m, v = np.zeros(columns + 1), np.zeros(columns + 1)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        logit = b + np.bincount(owner, value * w[column], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * weight
        g = np.append(np.bincount(column, value * error[owner], minlength=columns) + l2 * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from about rows labelled texts outside the held-out fold. Texts stay on the executors: the driver gets counts by bucket, then each text's features."""
    bounded_batches(docs.sparkSession)
    chosen = table(sample(docs, labels, label, rows, folds, held_out, by_class=True, id_col=id_col, text_col=text_col).repartition(8), "sample")
    size = 1 << BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size), dtype=np.int32)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at:at + BATCH]
                owner, bucket = present(part["text"].tolist())
                of = part["label"].to_numpy()[owner]
                for k in (0, 1):
                    total[k] += np.bincount(bucket[of == k], minlength=size).astype(np.int32)
        yield pd.DataFrame({"counts": [total.tobytes()]})

    counts = np.zeros((2, size))
    for row in chosen.mapInPandas(count, "counts binary").toLocalIterator():
        counts += np.frombuffer(row["counts"], dtype=np.int32).reshape(2, size)
    ratio, wanted = log_count_ratios(counts)

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at:at + BATCH]
                owner, bucket, value = densities(part["text"].tolist(), wanted)
                cuts = np.searchsorted(owner, np.arange(1, len(part)))
                xs, vs = np.split(bucket.astype(np.int32), cuts), np.split(value.astype(np.float32), cuts)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "label": part["label"].to_numpy(), "weight": part["weight"].to_numpy(), "x": [p.tobytes() for p in xs], "v": [p.tobytes() for p in vs]})

    found = chosen.mapInPandas(select, "key long, label int, weight double, x binary, v binary").toPandas().sort_values(["key", "label"])
    y = found["label"].to_numpy(float)
    weights = np.zeros(size)
    if len(np.unique(y)) < 2:
        level = float(y.mean()) if len(y) else 0.0
        return Model(weights, float(np.clip(np.log(level + 1e-12) - np.log(1 - level + 1e-12), -40, 40)))
    x = [np.frombuffer(b, dtype=np.int32) for b in found["x"]]
    owner = np.repeat(np.arange(len(x)), [len(b) for b in x])
    kept = np.flatnonzero(wanted)
    column = np.searchsorted(kept, np.concatenate(x))
    value = ratio[kept][column] * np.frombuffer(b"".join(found["v"]), dtype=np.float32)
    w, b = regress(owner, column, value, y, found["weight"].to_numpy(), len(kept))
    weights[kept] = ratio[kept] * w
    return Model(weights.astype(np.float32), b)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, score) for each row of docs: the probability of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **options))
    return scored(docs, lambda texts: model.value.probability(texts).astype(float), BATCH, id_col, text_col)


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels).select(F.col("id").alias("doc_id"), (crc_mod("id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
