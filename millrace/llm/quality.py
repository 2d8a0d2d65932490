"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Null and empty texts are pooled to zeros and scored like any other. Labels that are null, or whose document is
missing, are left out; without labels of both classes each score is the mean label, 0.5 without any. Rows that repeat an id are scored each. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, own_columns
from .labelled import sample, scored

#: Words are hashed to so many rows of vectors of so many dimensions; an index vector has so many entries of 1 or -1.
ROWS, DIMENSIONS, ENTRIES = 1 << 14, 32, 4
#: Words to either side that are a word's context.
WINDOW = 2
#: The classifier's bound: labelled rows it is fitted on, about.
SAMPLE = 12_000
#: From this score on a document is predicted to be good; fixed by the contract.
CUT = 0.3
#: Texts pooled at a time.
BATCH = 500

_token = re.compile(r"\w+|[^\w\s]+").findall


class _Ids(dict):
    """word -> row, remembered for up to a few hundred thousand words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = row = zlib.crc32(word.encode("utf-8", "surrogatepass")) % ROWS
        return row


def word_ids(texts: list[str], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words, and where each text ends."""
    words = [_token(t.lower()) for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    get = ids.__getitem__
    return np.fromiter((get(w) for part in words for w in part), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0), ends


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the entries of each row's index vector; the same everywhere."""
    r = np.random.default_rng(20)
    columns = np.argsort(r.random((ROWS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return columns, r.choice(np.array([-1.0, 1.0]), (ROWS, ENTRIES))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """[row, dimension]: for each word the sum of its neighbours' index vectors over the whole corpus, centred and of unit length.

    Each task sums into one array of fixed size and hands on the rows it has seen; Spark adds those up, and the
    driver gets ROWS vectors whatever the corpus.
    """

    bounded_batches(docs.sparkSession)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, (columns, signs) = _Ids(), index_vectors()
        total = np.zeros(ROWS * DIMENSIONS)
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), BATCH):
                words, ends = word_ids(texts[at:at + BATCH], ids)
                owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                for off in range(1, WINDOW + 1):
                    same = owner[off:] == owner[:-off]
                    a, b = words[:-off][same], words[off:][same]
                    for to, of in ((a, b), (b, a)):
                        place = (to * DIMENSIONS)[:, None] + columns[of]
                        total += np.bincount(place.ravel(), signs[of].ravel(), minlength=ROWS * DIMENSIONS)
        grid = total.reshape(ROWS, DIMENSIONS).astype(np.int64)
        seen = np.flatnonzero(np.abs(grid).sum(axis=1))
        out = pd.DataFrame(grid[seen], columns=[f"v{i}" for i in range(DIMENSIONS)])
        out.insert(0, "word", seen)
        yield out

    names = [f"v{i}" for i in range(DIMENSIONS)]
    texts = own_columns(docs, text=text_col).where(F.length("text") > 0)
    parts = texts.mapInPandas(summed, "word int, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("word").agg(*[F.sum(n).cast("double").alias(n) for n in names]).toPandas()
    vectors = np.zeros((ROWS, DIMENSIONS), dtype=np.float32)
    if len(rows):
        found = rows[names].to_numpy()
        length = np.linalg.norm(found, axis=1, keepdims=True)
        found = found / np.where(length > 0, length, 1)
        vectors[rows["word"].to_numpy()] = found - found.mean(axis=0)
    return vectors


def pooled(texts: list[str], vectors: np.ndarray, ids: _Ids) -> np.ndarray:
    """Mean and spread of each text's word vectors, and the log of its word count."""
    words, ends = word_ids(texts, ids)
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 1), dtype=np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        each, starts = vectors[words], (ends - sizes)[full]
        mean = np.add.reduceat(each, starts, axis=0) / sizes[full, None]
        square = np.add.reduceat(each * each, starts, axis=0) / sizes[full, None]
        out[full, :DIMENSIONS], out[full, DIMENSIONS:-1] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    out[:, -1] = np.log1p(sizes)
    return out


class Network:
    """Two layers, tanh and logistic; the logit is divided by a temperature that is fitted on rows left out of training."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 1):
        self.level = float(y.mean()) if len(y) else 0.5
        self.trained = len(np.unique(y)) == 2
        if not self.trained:
            return
        r = np.random.default_rng(seed)
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = ((x - self.middle) / self.scale).astype(np.float64)
        order = r.permutation(len(x))
        held, fit = order[: max(1, len(x) // 5)], order[len(x) // 5:]
        p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(self.level / (1 - self.level)))]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for part in np.array_split(r.permutation(fit), max(1, len(fit) // 128)):
                h = np.tanh(x[part] @ p[0] + p[1])
                error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[part]) / max(1, len(part))
                back = np.outer(error, p[2]) * (1 - h * h)
                grads = [x[part].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ error + 1e-4 * p[2], error.sum()]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit, truth = self.logit(x[held]), y[held]
        loss = lambda t: float(np.mean(np.logaddexp(0, logit / t) - truth * logit / t))
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.level)
        return 1 / (1 + np.exp(-np.clip(self.logit((x - self.middle) / self.scale) / self.temperature, -40, 40)))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs: the calibrated probability of label 1. Vectors come from all texts, the network from about rows labelled ones outside the held-out fold."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at:at + BATCH]
                yield pd.DataFrame({"key": part["key"], "label": part["label"], "x": list(pooled(part["text"].tolist(), vectors.value, ids).astype(float))})

    chosen = sample(docs, labels, label, rows, folds, held_out, id_col=id_col, text_col=text_col)
    fit = chosen.mapInPandas(pool, "key long, label int, x array<double>").toPandas().sort_values(["key", "label"])
    x = np.stack(fit["x"].to_numpy()) if len(fit) else np.zeros((0, 2 * DIMENSIONS + 1))
    network = spark.sparkContext.broadcast(Network(x, fit["label"].to_numpy(float)))
    ids = _Ids()
    return scored(docs, lambda texts: network.value.probability(pooled(texts, vectors.value, ids)), BATCH, id_col, text_col)


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, labels).select(F.col("id").alias("doc_id"), (crc_mod("id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
