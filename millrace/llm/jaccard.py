"""N-gram Jaccard join by PartEnum signatures.

A text that is null or has no words has an empty set and is linked with nothing. Equal sets are one class, so
copies cost one row each. Rows that repeat an id stay rows of their own; their class counts once. Further columns of any name pass
through. An empty table gives an empty result. Null ids are never the smallest of a component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_place, components, likely, named_back, place, settled, table, trim, without

#: Fixed by the contract: words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 3, 90
#: PartEnum's second level: parts that a first-level partition is split into, and how many of them may differ.
PARTS, DIFFER = 3, 1
#: Partitions to spare, as a share of those that the bound needs: so many of a set's emptiest ones give no signature.
SPARE = 0.15
#: A shingle is common if so many of a bounded sample of about so many texts have it.
COMMON, SAMPLE = 3, 8_000
#: Common shingles known at most; what is left out costs candidates.
MOST_COMMON = 1 << 18
#: Shingles that one task compares with as many others at a time.
UNIT = 200_000
#: Signatures are kept in slices by their value and matched in rounds of some slices each: so many that a round's shuffles take
#: about half as much as the texts at most, with so many bytes a signature.
SLICES, SIGN_BYTES = 16, 48
#: Texts count as so many bytes at least: what a round of a small table shuffles is little, and each round costs the driver a dozen jobs.
LEAST_BYTES = 64 << 20
#: Texts at a time.
BATCH = 400

_U = np.uint64


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ _U(salt)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The different shingles of each text as sorted 64-bit hashes; a text with fewer words is one shingle."""
    out = []
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        parts = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, both go by ASCII alone
        h = np.fromiter(map(digest, parts), dtype=_U, count=len(parts))
        n = min(words, len(parts))
        if n == 0:
            out.append(h)
            continue
        total = np.zeros(len(h) - n + 1, dtype=_U)
        for i in range(n):
            total = (total * _U(0x100000001B3)) + _mixed(h[i:len(h) - n + 1 + i], i + 1)
        out.append(np.unique(_mixed(total, n)))
    return out


class Bands:
    """Size bands and, for each, how much two similar sets of it can differ.

    Sets of one band, or of neighbouring bands, can be similar, others cannot: the least size of the next band but one is
    over 1 / similarity times the largest of a band. A set signs in its own band and in the next, so a similar pair
    meets in the band of its larger set, where the sets differ in at most differ(band) elements.
    """

    def __init__(self, percent: int):
        self.percent, self.largest = percent, [0]

    def of(self, size: int) -> int:
        while self.largest[-1] < size:
            self.largest.append(max(self.largest[-1] + 1, (self.largest[-1] + 1) * 100 // self.percent))
        return int(np.searchsorted(self.largest, size))

    def differ(self, band: int) -> int:
        self.of(self.largest[-1] + 1) if band >= len(self.largest) else None
        return (100 - self.percent) * 2 * self.largest[band] // (100 + self.percent)


def _missing(x: np.ndarray, common: np.ndarray) -> np.ndarray:
    """1 where an element of x is not in common, which is sorted."""
    if not len(common):
        return np.ones(len(x))
    return (common[np.minimum(np.searchsorted(common, x), len(common) - 1)] != x).astype(float)


def signatures(sets: list[np.ndarray], bands: Bands, common: np.ndarray | None = None, parts: int = PARTS, differ: int = DIFFER, spare: float = SPARE) -> list[np.ndarray]:
    """PartEnum signatures of each set: if two sets of similar size differ in few enough elements, they share one.

    For a bound k on the difference, the domain is hashed to k // (differ + 1) + 1 partitions and a share more, w of them, to spare: so
    in at least w + 1 partitions at most differ elements differ. Each partition falls in parts subparts, and some choice of
    parts - differ of these holds no element that differs. A choice is a signature: the hash of the elements in it.
    Signatures of few elements, empty ones above all, say little, and so do those of common elements, as in a passage that many
    texts share. The worth of a signature is how many elements not in common (sorted) it holds; a set leaves out the signatures below the worth that all but
    at most w of its partitions reach in each choice. Of two similar sets take the one with the higher such worth: a partition in which they agree
    to within differ elements is among those that reach it, so a shared choice is worth enough for both sets. No similar pair is lost, whatever is common.
    Where k is 0 only equal sets are similar, which need no signature.
    """
    made = [[] for _ in sets]
    choices = list(combinations(range(parts), parts - differ))
    for step in (0, 1):
        band = np.array([bands.of(len(s)) + step if len(s) else 0 for s in sets])
        k = np.array([bands.differ(b) if b else 0 for b in band])
        some = np.flatnonzero(k > 0)
        if not len(some):
            continue
        extra = np.ceil(spare * (k[some] // (differ + 1) + 1)).astype(np.int64)
        first = k[some] // (differ + 1) + 1 + extra
        sizes = np.array([len(sets[i]) for i in some])
        flat = np.concatenate([sets[i] for i in some])
        base = np.cumsum(first) - first
        at = np.repeat(base * parts, sizes) + ((_mixed(flat, 11) >> _U(20)) % np.repeat(first * parts, sizes).astype(_U)).astype(np.int64)
        prints = np.zeros(int(first.sum()) * parts, dtype=_U)
        np.add.at(prints, at, _mixed(flat, 23))
        held = np.bincount(at, None if common is None else _missing(flat, common), minlength=len(prints)).reshape(-1, parts)
        prints = prints.reshape(-1, parts)
        owner = np.repeat(np.arange(len(some)), first)
        number = (np.arange(len(prints)) - base[owner]).astype(_U)
        where = _mixed(band[some][owner].astype(_U) << _U(32) | number, 37)
        least = np.sort(held, axis=1)[:, :parts - differ].sum(axis=1)  # what the smallest choice of each partition holds
        enough = least[np.lexsort((least, owner))][base + extra][owner]
        each, keep = [], []
        for c, chosen in enumerate(choices):
            total = where + _U(c * 0x2545F4914F6CDD1D & (1 << 64) - 1)
            for i in chosen:
                total = _mixed(total + prints[:, i], 41 + i)
            each.append(total)
            keep.append(held[:, list(chosen)].sum(axis=1) >= enough)
        each, keep = np.stack(each, axis=1), np.stack(keep, axis=1)
        for i, b, n in zip(some, base, first, strict=True):
            made[i].append(each[b:b + n][keep[b:b + n]])
    return [np.concatenate(m).view(np.int64) if m else np.zeros(0, np.int64) for m in made]


def linked(sets: list[np.ndarray], groups: list[int], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places whose sets are similar, no more than join what groups (place -> number) leaves apart; with sides, only across them.

    Postings of the shared elements count each set's intersections with all others at once; a set whose possible partners are all
    in its group already is not compared any more, so a tight group costs one comparison a member.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(element, kind="stable")
    posting, ends = owner[order], np.cumsum(np.bincount(element))
    starts = np.concatenate([[0], ends[:-1]])
    of_set = np.cumsum(size) - size
    _, group = np.unique(np.asarray(groups), return_inverse=True)
    out = []
    for i in range(m):
        apart = group != group[i]
        if sides is not None:
            apart &= sides != sides[i]
        apart &= (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if not apart.any():
            continue
        e = element[of_set[i]:of_set[i] + size[i]]
        count = ends[e] - starts[e]
        place = np.arange(count.sum()) + np.repeat(starts[e] - (np.cumsum(count) - count), count)
        both = np.bincount(posting[place], minlength=m)
        for j in np.flatnonzero(apart & (100 * both >= percent * (size + size[i] - both))):
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def in_slices(signs: np.ndarray) -> list[np.ndarray]:
    """Signatures by their remainder modulo SLICES."""
    place = signs.view(_U) % _U(SLICES)
    order = np.argsort(place, kind="stable")
    return np.split(signs[order], np.cumsum(np.bincount(place.astype(np.int64), minlength=SLICES))[:-1])


def _id_text():
    return F.coalesce(F.col("id").cast("string"), F.lit("\x00"))


def common_shingles(source: DataFrame, words: int) -> np.ndarray:
    """Shingles of COMMON or more of about SAMPLE different texts, the MOST_COMMON commonest at most, sorted: what the index learns from a
    bounded sample, whatever the length of its texts. It decides what candidates cost, never which links are found."""
    share = min(1.0, SAMPLE / max(1, source.count()))
    some = source.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    some = some.withColumn("same", F.xxhash64("text")).dropDuplicates(["same"])

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                yield pd.DataFrame({"element": np.concatenate(shingle_sets(batch["text"].iloc[at:at + BATCH].tolist(), words)).view(np.int64)})

    counted = some.select("text").mapInPandas(elements, "element long").groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    most = counted.orderBy(F.desc("n"), "element").limit(MOST_COMMON)
    return np.sort(most.select("element").toPandas()["element"].to_numpy(np.int64).view(_U))


def _compared(units: DataFrame, keys: list[str], percent: int, unit: int) -> DataFrame:
    """(a, b): links within each unit that keys name, of rows (node, elements, block, group, unit, other, *keys). Units are mostly small:
    a task takes many of them, about unit shingles together."""
    size = units.agg(F.sum("size")).first()[0] or 0
    part = F.pmod(F.xxhash64(*keys), F.lit(1 + size // unit))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, elements, blocks, groups, crossed = pdf["node"].to_numpy(), pdf["elements"].to_numpy(), pdf["block"].to_numpy(), pdf["group"].to_numpy(), (pdf["unit"] != pdf["other"]).to_numpy()
        found = []
        for at in pdf.groupby(keys, sort=False).indices.values():
            if len(at) > 1:
                links = linked([np.asarray(elements[i]).view(_U) for i in at], groups[at].tolist(), percent, blocks[at] if crossed[at[0]] else None)
                found += [(nodes[at[i]], nodes[at[j]]) for i, j in links]
        if len(nodes) > 1_000:
            trim()
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return table(units.groupBy(part.alias("part")).applyInPandas(compare, "a long, b long"), "links", small=True)


def _groups(source: DataFrame, words: int, percent: int, unit: int, parts: int, differ: int, spare: float) -> DataFrame:
    """(place, id, n, first) for each row of source (place, id, text): first is (none, id, place) of the least row of its group, by id, null last, then by place.

    1. One pass over the texts makes each set's size, fingerprint and signatures; equal sets become one class.
    2. Classes that share a signature are joined to the least of them: star edges, never the pairs within a group. Their
       components are the only places where links can be.
    3. The texts of these classes alone are read again and compared exactly, in units of bounded size: a component's classes are dealt to
       blocks by hash, each compared within and with the component's first class. So a tight component costs time in proportion to its size.
    4. Where that leaves a component in more than one group, its classes are compared once more: those that share a signature,
       and only where these are in more than one group. So what a loose component costs goes by what shares signatures, not by its square.
    """
    spark = source.sparkSession
    bounded_batches(spark)
    kind = source.schema["id"].dataType
    source = source.select("place.file", "place.at", "id", F.coalesce("text", F.lit("")).alias("text"))
    known = spark.sparkContext.broadcast(common_shingles(source, words))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at:at + BATCH]
                sets = shingle_sets(part["text"].tolist(), words)
                signs = signatures(sets, bands, known.value, parts, differ, spare)
                yield pd.DataFrame({
                    "file": part["file"], "at": part["at"], "id": part["id"], "n": [len(s) for s in sets],
                    "one": [_mixed(s, 3).sum(dtype=_U).astype(np.int64) for s in sets], "two": [_mixed(s, 5).sum(dtype=_U).astype(np.int64) for s in sets],
                    "bytes": part["text"].str.len(),
                    "many": [len(x) for x in signs], "signs": [in_slices(x) for x in signs],
                })
        trim()

    signed = source.withColumn("id", _id_text()).mapInPandas(sign, "file long, at long, id string, n int, one long, two long, bytes long, many long, signs array<array<long>>")
    signed = table(signed.withColumn("node", F.monotonically_increasing_id()), "signed")  # node is settled once written
    sets = ["n", "one", "two"]
    own = F.nullif("id", F.lit("\x00")).cast(kind)
    row = F.struct(own.isNull().alias("none"), own.alias("id"), F.struct("file", "at").alias("place"))
    classes = table(signed.where("n > 0").groupBy(*sets).agg(F.min("node").alias("node"), F.min(row).alias("first")), "classes", small=True)
    reps = classes.select("node")
    total = signed.agg(F.sum("many"), F.sum("bytes")).first()
    rounds = min(SLICES, max(1, -(-2 * SIGN_BYTES * (total[0] or 0) // max(LEAST_BYTES, total[1] or 0))))
    found = []

    def slice_of(k: int) -> DataFrame:
        """(node, signs): the signatures of one round."""
        return signed.select("node", F.flatten(F.array(*[F.get("signs", F.lit(i)) for i in range(k, SLICES, rounds)])).alias("signs"))

    for k in range(rounds):
        signs = slice_of(k).join(reps, "node", "left_semi").select("node", F.explode("signs").alias("sign"))
        shared = signs.groupBy("sign").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
        found.append(table(signs.join(shared, "sign").where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct(), "edges", small=True))
    edges = reduce(DataFrame.union, found)
    clusters = components(edges).select(F.col("id").alias("node"), F.col("root").alias("cluster"))
    members = table(clusters.join(signed.select("node", "file", "at", F.col("n").alias("size")), "node"), "members", small=True)
    # blocks are dealt while rows are narrow: what carries elements is only ever shuffled by node, or by unit
    load = members.groupBy("cluster").agg(F.ceil(F.sum("size") / F.lit(unit)).cast("int").alias("blocks"))
    members = members.join(load, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = table(members, "members", small=True)

    # texts of members: a filter of bounded size first, so that few others are shuffled
    deal = ["node", "size", "cluster", "blocks", "block"]
    to_read = likely(source.select("file", "at", "text"), members, ["file", "at"]).join(members, ["file", "at"]).select(*deal, "text")

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at:at + BATCH]
                yield part[deal].assign(elements=[s.view(np.int64) for s in shingle_sets(part["text"].tolist(), words)])
        trim()

    held = table(to_read.mapInPandas(again, "node long, size int, cluster long, blocks int, block int, elements array<long>"), "held")
    columns = ["node", "size", "elements", "block"]
    where = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    within = held.select(*columns, "cluster", F.explode(where).alias("unit")).withColumn("other", F.col("unit")).withColumn("group", F.col("node"))
    links = _compared(within, ["cluster", "unit"], percent, unit)
    if not members.where("blocks > 1").isEmpty():
        joined = components(links).select(F.col("id").alias("node"), F.col("root").alias("joined"))
        state = members.where("blocks > 1").select("node", "size", "cluster").join(joined, "node", "left").withColumn("group", F.coalesce("joined", "node")).drop("joined")
        loose = state.groupBy("cluster").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x < y").select("cluster")
        state = table(state.join(loose, "cluster", "left_semi").select("node", "size", "group"), "loose", small=True)
        if not state.isEmpty():
            met = []
            for k in range(rounds):
                signs = slice_of(k).join(state, "node").select("node", "size", "group", F.explode("signs").alias("sign"))
                lists = signs.groupBy("sign").agg(F.min("group").alias("list"), F.max("group").alias("last")).where("list < last").select("sign", "list")
                met.append(table(signs.join(lists, "sign").select("list", "node", "size", "group").distinct(), "met", small=True))
            # signatures with the same first group are one list, in which a class stands once, however many of them it has
            met = reduce(DataFrame.union, met).distinct()
            load = met.groupBy("list").agg(F.ceil(F.sum("size") / F.lit(unit)).cast("int").alias("blocks"))
            met = met.join(load, "list").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            met = table(met.select("node", "size", "group", "list", "block", F.least("block", "with").alias("unit"), F.greatest("block", "with").alias("other")), "met", small=True)
            across = met.join(held.select("node", "elements"), "node")
            links = links.union(_compared(across, ["list", "unit", "other"], percent, unit))
    found = components(links).select(F.col("id").alias("node"), "root")
    named = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    named = named.drop("first").join(firsts, "root").select(*sets, "first")
    return signed.select(F.struct("file", "at").alias("place"), own.alias("id"), *sets).join(named, sets, "left").select("place", "id", "n", "first")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, parts: int = PARTS, differ: int = DIFFER, spare: float = SPARE) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; component_id is the least id that links lead to."""
    docs = settled(docs)
    found = _groups(docs.select(place(docs).alias("place"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), words, percent, unit, parts, differ, spare)
    return found.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"))


def first_of_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, parts: int = PARTS, differ: int = DIFFER, spare: float = SPARE) -> DataFrame:
    """docs with one row of each group of similar texts: that of the least id, a null id last; of rows that share this id, the first by place. Texts without words stay."""
    rows = by_place(docs)
    at = lambda c: F.col(f"c{docs.columns.index(c)}")
    found = _groups(rows.select(F.col("_place").alias("place"), at(id_col).alias("id"), at(text_col).alias("text")), words, percent, unit, parts, differ, spare)
    dropped = table(found.where((F.col("n") > 0) & (F.col("place") != F.col("first.place"))).select(F.col("place").alias("_place")), "dropped", small=True)
    return named_back(without(rows, "_place", dropped), docs)


def op7(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
