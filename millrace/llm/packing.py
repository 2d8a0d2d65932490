"""Best-fit packing by minimum bin slack: each bin is the fullest combination of the lengths that are left.

Null text counts as empty: one piece with the end id alone. Rows that repeat an id are documents of their own and are
packed each. An empty table gives an empty result. Long texts are tokenised whole, then cut.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, own_columns, running_total, table, trim, uniform_key

#: Tokens a sequence holds, and the id after each document.
CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def fast_encoder(path: str):
    """text -> ids, the same as tokenizers' encode(text, add_special_tokens=False) gives for a byte-level BPE file, some four times as fast.

    The file's byte alphabet, merges and added tokens are read as they are; ranks are ids, which holds where each merge's result has an id by
    order of merges. That is checked, and a file for which it does not hold is served by tokenizers itself.
    """
    import json

    import public_tokenizers
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in added}
    ids = [vocabulary[m] for m in merged]
    in_order = all(a < b for a, b in zip(ids, ids[1:], strict=False))
    plain = spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
    if not (in_order and plain):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda text: own.encode(text, add_special_tokens=False).ids
    # the byte alphabet: printable bytes stand for themselves, the others for 256, 257 and so on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in vocabulary.items()}
    encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all")


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole if it fits, else full pieces after a first that may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece, as a written table; ids themselves are not kept."""

    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = fast_encoder(path)
        end = struct.pack("<I", end_id)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.asarray(encode(text), dtype="<u4").tobytes() + end
                out += [(doc_id, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity))]
            made = pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])
            made["id"] = made["id"].astype(batch["id"].dtype)
            yield made
        trim()

    rows = own_columns(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["id"].dataType
    text_id = F.coalesce(F.col("id").cast("string"), F.lit("\x00")).alias("id")  # ids cross to pandas as text: nulls and long numbers stay exact
    made = rows.select(text_id, "text").mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long")
    return table(made.withColumn("id", F.nullif("id", F.lit("\x00")).cast(kind)), "pieces")


def fullest(available: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """length -> how many, of the fullest combination of the available (length, count) that fits; longest lengths first.

    Subset sums as bits of one integer: bit s is set if s can be reached. Each length goes in with its count split in powers of two; the
    sets on the way are kept to walk back from the fullest sum. As soon as the full capacity is reached, the rest is left out.
    """
    steps: list[tuple[int, int, int]] = []  # length, copies, set before
    sums, mask, goal = 1, (1 << (capacity + 1)) - 1, 1 << capacity
    for length, count in available:
        count, k = min(count, capacity // length), 1
        while count > 0:
            take = min(k, count)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            count, k = count - take, 2 * k
            if sums & goal:
                break
        if sums & goal:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # not reachable without this step
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, length -> how many in each of these bins) until nothing is left. The longest length that is left is in each bin.

    It works on counts of lengths, so its cost depends on the capacity, not on the corpus: a combination fills as many bins
    as its counts allow, and then at least one length has too few left for another.
    """
    left, out = dict(sorted(histogram.items(), reverse=True)), []
    while left:
        longest = next(iter(left))
        rest = [(n, c - (n == longest)) for n, c in left.items()]
        used = fullest([(n, c) for n, c in rest if c], capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        bins = min(left[n] // k for n, k in used.items())
        out.append((bins, used))
        for n, k in used.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """length, first: ranks from first on of that length, up to the next row's, go to sequence + rank - first, at offset."""
    rows, taken, sequence = [], {}, 0
    for bins, used in patterns:
        offset = 0
        for length, k in sorted(used.items(), reverse=True):
            for _ in range(k):
                rows.append((length, taken.get(length, 0), sequence, offset))
                taken[length] = taken.get(length, 0) + bins
                offset += length
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    What reaches the driver is a histogram of at most capacity lengths, and what goes back is the combinations' slots, whose number
    depends on the capacity alone. Pieces are ranked among those of their length by distributed prefix sums,
    as a third of all pieces may have one length; rank and length name the slot.
    """
    parts = pieces(docs, path, capacity, end_id, id_col, text_col)
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    plan = slots(minimum_bin_slack(histogram, capacity))
    # one sorted key for both: the histogram's counts stay far below 2 ** 50
    keys = (plan["length"].to_numpy(np.int64) << 50) + plan["first"].to_numpy(np.int64)
    first, sequence, offset = (plan[c].to_numpy(np.int64) for c in ("first", "sequence", "offset"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch.pop("rank").to_numpy(np.int64)
            k = np.searchsorted(keys, (batch["length"].to_numpy(np.int64) << 50) + rank, side="right") - 1
            yield batch.assign(sequence_id=sequence[k] + rank - first[k], offset=offset[k])

    kind = parts.schema["id"].dataType
    ranked = running_total(
        parts.withColumn("key", uniform_key(F.col("id"), F.col("piece"), F.col("ids_crc32"))).withColumn("one", F.lit(1)),
        ["length"], "key", ["id", "piece", "ids_crc32"], "one", "rank")
    text_id = F.coalesce(F.col("id").cast("string"), F.lit("\x00")).alias("id")
    placed = ranked.select(text_id, "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        place, "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("id", F.nullif("id", F.lit("\x00")).cast(kind))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")
