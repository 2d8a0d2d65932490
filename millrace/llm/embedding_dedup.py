"""Embedding near-dedup by a pivot-permutation index.

Vectors that are null, zero, of no components, or that hold null or non-finite components are linked with nothing, nor are those without a
label; vectors of different lengths are not compared. Equal vectors of a label are one class. Rows that repeat an id stay rows; each counts as a vector. An
empty table gives an empty result. Null ids are never the smallest of a component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, own_columns, table

#: Fixed by the contract: the least cosine of a link.
COSINE = 0.93
#: The index's bounded sample: reference points, of any label, chosen by hash: one for so many vectors, within bounds.
#: With the most, each list has about the same length up to some three million vectors; from there on lists grow with the rows.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 100, 64, 32_768
APART = 0.8
#: Candidates that are held against the pivots at a time.
CHUNK = 1_024
#: A vector is described by so many of its nearest pivots; a pair is verified if it shares so many of these.
NEAREST, SHARED = 6, 3
#: Vectors that one task compares with as many others at a time.
UNIT = 2_000
#: Rows of lists that go to Python together.
GROUP_ROWS = 10_000


def choose_pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By length of vector, up to about count / PER_PIVOT unit vectors as [pivot, component], those least by a hash: a bounded sample of what is indexed.

    Equal vectors count once, and none is taken within APART of one that is: pivots from one near group would
    stand in random order in the permutations of that group.
    """
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, count // PER_PIVOT))
    share = min(1.0, 4.0 * wanted / max(1, count))
    key = F.xxhash64(F.lit("pivot"), "vector")
    rows = vectors.select("size", "vector", key.alias("key")).where(F.pmod("key", F.lit(1 << 30)) < share * (1 << 30)).distinct().orderBy("key").limit(2 * wanted).collect()
    sampled: dict[int, list] = {}
    for r in rows:
        sampled.setdefault(r["size"], []).append(r["vector"])
    return {n: spread(unit(np.array(v, dtype=np.float64)), wanted) for n, v in sampled.items()}


def spread(x: np.ndarray, wanted: int) -> np.ndarray:
    """The first of the unit vectors x, up to wanted, none within APART of one before it."""
    taken, n = np.zeros((min(wanted, len(x)), x.shape[1])), 0
    for at in range(0, len(x), CHUNK):
        part = x[at:at + CHUNK]
        part = part[(part @ taken[:n].T < APART).all(axis=1)]
        near = part @ part.T >= APART
        chosen: list[int] = []
        for i in range(len(part)):
            if n + len(chosen) < wanted and not near[i, chosen].any():
                chosen.append(i)
        taken[n:n + len(chosen)] = part[chosen]
        n += len(chosen)
    return taken[:n]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutations_of(x: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """For each unit vector the numbers of its nearest pivots, nearest first."""
    nearest = min(nearest, len(pivots))
    near = x @ pivots.T
    top = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def postings(ordered: np.ndarray, shared: int = SHARED) -> list[tuple[int, ...]]:
    """The entries of one vector in the inverted lists: each choice of shared of its pivots, so that the vectors with at least that shared-pivot count meet."""
    return list(combinations(sorted(int(p) for p in ordered), min(shared, len(ordered))))


def compare_unit(vec: np.ndarray, own: np.ndarray, weight: np.ndarray, entry: np.ndarray, side: np.ndarray | None, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of vectors that share an entry: for each, the vectors linked with it whose least common entry is this one, and a spanning forest of the links.

    own has each vector's pivots in rising order. A pair meets once for each choice of its common pivots and is counted at
    the first, where no common pivot lies before the entry's last but those of the entry.
    """
    m = len(vec)
    counts, forest, group = np.zeros(m, dtype=np.int64), [], np.arange(m)
    last = entry[-1]
    for at in range(0, m, 256):
        near = vec[at:at + 256] @ vec.T >= cosine
        rows = np.arange(at, min(at + 256, m))
        near[np.arange(len(rows)), rows] = False
        if side is not None:
            near &= side[rows][:, None] != side[None, :]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i = i + at
        before = np.zeros(len(i), dtype=np.int32)
        for c in range(own.shape[1]):
            p = own[i, c]
            here = p <= last
            before[here] += (own[j[here]] == p[here][:, None]).any(axis=1)
        good = before == len(entry)
        i, j = i[good], j[good]
        np.add.at(counts, i, weight[j])
        for a, b in zip(i[i < j], j[i < j], strict=True) if len(np.unique(group)) > 1 else ():
            if group[a] != group[b]:
                forest.append((int(a), int(b)))
                group[group == group[b]] = group[a]
    return counts, forest


def near_groups(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", unit_rows: int = UNIT) -> DataFrame:
    """(id, n_links, component_id) for each row: how many other vectors it is linked with, and the least id that links lead to.

    Every vector is indexed. An inverted list is dealt by hash to blocks of about unit_rows vectors, and pairs of blocks are
    compared: no list meets in one task, and what a task returns is a count per vector and a forest, never its pairs.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    named = own_columns(rows, id=id_col, vector=vector_col, label=label_col)
    if dict(named.dtypes)["vector"] != "array<float>":  # what is single stays so on its way; cosines are double
        named = named.withColumn("vector", F.col("vector").cast("array<double>"))
    usable = F.col("label").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    kept = named.withColumn("usable", F.coalesce(usable, F.lit(False)))
    kept = table(kept.withColumn("row", F.monotonically_increasing_id()).withColumn("print", F.md5(F.to_json(F.struct("label", "vector")))), "vectors")
    classes = table(kept.where("usable").groupBy("print").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    nodes = kept.join(classes.select(F.col("node").alias("row"), "copies"), "row").select(F.col("row").alias("node"), "copies", "label", "vector", F.size("vector").alias("size"))
    nodes = table(nodes, "nodes")
    pivots = spark.sparkContext.broadcast(choose_pivots(nodes, nodes.count()))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                if size not in pivots.value:  # no pivot of this length: one list for all
                    yield pd.DataFrame({"node": part["node"], "entries": [[""]] * len(part), "own": [[]] * len(part)})
                    continue
                for at in range(0, len(part), 1_000):
                    some = part.iloc[at:at + 1_000]
                    near = permutations_of(unit(np.stack(some["vector"].to_numpy()).astype(np.float64)), pivots.value[size])
                    yield pd.DataFrame({"node": some["node"], "entries": [["-".join(map(str, e)) for e in postings(r)] for r in near], "own": list(np.sort(near, axis=1))})

    found = nodes.select("node", "size", "vector").mapInPandas(index, "node long, entries array<string>, own array<int>")
    indexed = table(nodes.join(found, "node"), "indexed")
    lists = ["label", "size", "entry"]
    sizes = indexed.select("label", "size", F.explode("entries").alias("entry")).groupBy(*lists).agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / F.lit(unit_rows)).cast("int"))
    placed = indexed.select("node", "copies", *lists[:2], F.explode("entries").alias("entry")).join(sizes, lists)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("unit", F.least("block", "with")).withColumn("other", F.greatest("block", "with"))
    # many lists to a task: short ones by their first pivot, so that a vector with twenty entries goes to four tasks at most, long ones by their blocks
    rows_in_all = sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    spot = F.when(F.col("blocks") == 1, F.xxhash64(*lists[:2], F.substring_index("entry", "-", 1))).otherwise(F.xxhash64(*lists, "unit", "other"))
    placed = placed.withColumn("part", F.pmod(spot, F.lit(1 + rows_in_all // GROUP_ROWS)))
    # a place: the list's name, the entry, and the block, -1 where a list is compared within
    place = F.concat_ws("#", F.md5(F.to_json(F.struct(*lists, "unit", "other"))), "entry", F.when(F.col("unit") == F.col("other"), -1).otherwise(F.col("block")).cast("string"))
    placed = placed.groupBy("part", "node", "copies").agg(F.collect_list(place).alias("places"))
    units = placed.join(indexed.select("node", "size", "vector", "own"), "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, owns, node, copies = (pdf[c].to_numpy() for c in ("vector", "own", "node", "copies"))
        found: dict[str, list[tuple[int, int]]] = {}
        for i, places in enumerate(pdf["places"]):
            for p in places:
                name, _, block = p.rpartition("#")
                found.setdefault(name, []).append((i, int(block)))
        counted, totals, edges = [], [], []
        for name, rows in found.items():
            if len(rows) < 2:
                continue
            at, block = np.array([i for i, _ in rows]), np.array([b for _, b in rows])
            pivots_of = np.array([int(p) for p in name.rpartition("#")[2].split("-") if p], dtype=np.int32)
            own = np.stack(owns[at]).astype(np.int32).reshape(len(at), -1)
            if not len(pivots_of):
                own, pivots_of = np.zeros((len(at), 1), np.int32), np.zeros(1, np.int32)
            counts, forest = compare_unit(unit(np.stack(vectors[at]).astype(np.float64)), own, copies[at], pivots_of, block if block[0] >= 0 else None, cosine)
            some = np.flatnonzero(counts)
            counted.append(node[at][some])
            totals.append(counts[some])
            edges += [(node[at[i]], node[at[j]], 0) for i, j in forest]
        empty = [np.zeros(0, np.int64)]
        out = pd.DataFrame({"a": np.concatenate(counted or empty), "b": -1, "n": np.concatenate(totals or empty)})
        return pd.concat([out, pd.DataFrame(edges, columns=["a", "b", "n"])]).astype("int64")

    compared = table(units.groupBy("part").applyInPandas(compare, "a long, b long, n long"), "compared", small=True)
    counts = compared.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = components(compared.where("b >= 0").select("a", "b")).select(F.col("id").alias("node"), "root")
    known = classes.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    known = known.select("print", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = kept.join(known, kept["usable"] & (kept["print"] == known["print"]), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op10(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
