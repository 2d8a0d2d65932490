"""Language ID by cross-parsing: the language whose labelled text parses a text into the fewest normalised phrases.

A text that is null or has no letter is 'und' with score 0. Rows that repeat an id are judged one by one. With no labelled
text at all every text is 'und'. Ties go to the language that is first by code point. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, own_columns, trim

#: The model's bound: labelled rows that each language is learned from, of so many characters at most each, and so many together. Rows are taken whole or not at all.
TRAIN_ROWS, TRAIN_TEXT_CHARS, TRAIN_CHARS = 60, 20_000, 80_000
#: Texts are parsed whole. Their segments of so many letters are parsed side by side, then joined where the parse of one runs into the next.
SEGMENT = 256
#: A state with more transitions is given few draws for its row, as it hardly fits among others.
DENSE = 48
#: Texts at a time, and their characters together, but for one text that alone has more.
BATCH, BATCH_CHARS = 600, 1 << 20
UNDEFINED = "und"


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """For each state of the suffix automaton of codes its transitions, letter -> state; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] != length[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return step


def packed_rows(states: np.ndarray, letters: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """(where, cells): where of each state so that the cells where[state] + letter of all its edges are its own, and no two states have the same where.

    states is in rising order. Rows go by length, the longest first, to places drawn at random with a fixed seed; what finds no room in some draws
    is laid behind all others. A state without edges is at cells, behind which no cell is taken.
    """
    draw = np.random.default_rng(0)
    width = int(letters.max(initial=0)) + 1
    size = np.bincount(states, minlength=count)
    begin = np.cumsum(size) - size
    cells = len(states) * 3 // 2 + width
    used, taken, claim, place = np.zeros(cells + width, bool), np.zeros(cells, bool), np.zeros(cells + width, np.int32), np.zeros(cells, np.int32)
    where = np.zeros(count, dtype=np.int64)
    for k in np.unique(size[size > 0])[::-1]:
        open_ = np.flatnonzero(size == k)
        for _ in range(64 if k <= DENSE else 8):
            at = draw.integers(0, cells, len(open_))
            row = letters[begin[open_][:, None] + np.arange(k)] + at[:, None]
            free = np.flatnonzero(~taken[at] & ~used[row].any(axis=1))
            at, row = at[free], row[free]
            claim[row], place[at] = free[:, None], free  # of rows that clash the last has the cell
            won = (claim[row] == free[:, None]).all(axis=1) & (place[at] == free)
            used[row[won]] = taken[at[won]] = True
            where[open_[free[won]]] = at[won]
            open_ = np.delete(open_, free[won])
            if not len(open_):
                break
        if len(open_):
            where[open_] = cells + width * np.arange(1, len(open_) + 1)
            grown = width * (len(open_) + 1)
            used, taken, claim, place = (np.concatenate([x, np.zeros(grown, x.dtype)]) for x in (used, taken, claim, place))
            used[letters[begin[open_][:, None] + np.arange(k)] + where[open_][:, None]] = taken[where[open_]] = True
            cells += grown
    # behind the last row
    end = cells + width
    where[size == 0] = end
    return where, end


class Automaton:
    """Transitions of one language over letters of its own: 0 is what no letter is, 1 a letter it has not learned, others go by frequency.

    The rows of all states lie in one another's gaps: a state is known by where its row begins, and a cell of the row is its own if its owner says so.
    So memory goes by the edges, whatever the letters. A place in a parse is a state, doubled; the low bit says that the letter that led there began a phrase.
    """

    def __init__(self, codes: np.ndarray, letters: int):
        found, counts = np.unique(codes[codes > 1], return_counts=True)
        order = found[np.argsort(-counts, kind="stable")]
        self.own = np.ones(letters, dtype=np.int32)  # the common alphabet's letters in this language's
        self.own[0] = 0
        self.own[order] = np.arange(2, 2 + len(order))
        self.size = max(2, len(codes))
        step = suffix_automaton(self.own[codes].tolist())
        self.states = len(step)
        p, c, q = np.array([(p, c, q) for p, ways in enumerate(step) for c, q in ways.items()], dtype=np.int64).reshape(-1, 3).T
        root = p == 0  # no edge leads there: a parse is at the start, or where a phrase's last letter has led
        where, end = packed_rows(p[~root], c[~root], self.states)
        width = len(order) + 2
        kind = np.int32 if (end + width) * 2 < 1 << 31 else np.int64
        # the state in which any letter begins a phrase: the start, and where a letter that is not learned has been a phrase
        self.start = kind(end * 2)
        self.first = np.full(width, self.start + 1, dtype=kind)
        self.first[c[root]] = where[q[root]] * 2 + 1
        self.owner, self.next = np.full(end + width, -1, dtype=kind), np.zeros(end + width, dtype=kind)
        cell = where[p[~root]] + c[~root]
        self.owner[cell], self.next[cell] = where[p[~root]], where[q[~root]] * 2

    def step(self, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Places after one letter more, of this language's alphabet."""
        state = at >> 1
        cell = state + letter
        return np.where(self.owner.take(cell) == state, self.next.take(cell), self.first.take(letter))


class CrossParser:
    """One automaton a language. The common alphabet: 0 is what no letter is, runs of it as one; 1: letters that no language has learned."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        folded = {k: self.fold(v) for k, v in texts.items()}
        known = sorted({c for v in folded.values() for c in v if c.isalpha()})
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        self.code[[ord(c) for c in known]] = np.arange(2, 2 + len(known))
        self.automata = [Automaton(self.encode(folded[language]), 2 + len(known)) for language in self.languages]
        self.sizes = [a.size for a in self.automata]

    @staticmethod
    def fold(text: str) -> str:
        return unicodedata.normalize("NFC", text).lower()

    def encode(self, folded: str) -> np.ndarray:
        codes = self.code[np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        return codes[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its letters, and the phrases of its parse by each language [text, language], greedy from the first letter to the last."""
        coded = [self.encode(self.fold(t)) for t in texts]
        sizes = np.array([len(c) for c in coded], dtype=np.int64)
        letters = np.array([np.count_nonzero(c) for c in coded], dtype=np.int64)
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        lanes = (sizes + SEGMENT - 1) // SEGMENT
        owner = np.repeat(np.arange(len(texts)), lanes)
        if not len(owner):
            return letters, counts
        flat = np.concatenate(coded)
        del coded
        number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(np.cumsum(sizes) - sizes, lanes) + number * SEGMENT
        width = np.minimum(SEGMENT, sizes[owner] - number * SEGMENT)
        order = np.argsort(-width, kind="stable")
        alive = np.searchsorted(-width[order], -np.arange(int(width.max())), side="left")  # lanes longer than each step
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        for k, automaton in enumerate(self.automata):
            own = automaton.own[flat]
            begins = np.zeros(len(flat), dtype=np.int8)
            place = np.full(len(owner), automaton.start)
            from_ = begin[order]
            for i, n in enumerate(alive):
                at = from_[:n] + i
                place[:n] = automaton.step(place[:n], own[at])
                begins[at] = place[:n] & 1
            end = np.empty_like(place)
            end[order] = place
            self._join(automaton, own, begins, end, begin, width, number)
            counts[full, k] = np.add.reduceat(begins, starts, dtype=np.int64)
        return letters, counts

    @staticmethod
    def _join(automaton: Automaton, own: np.ndarray, begins: np.ndarray, end: np.ndarray, begin: np.ndarray, width: np.ndarray, number: np.ndarray) -> None:
        """Corrects begins where a parse runs from a segment into the next: from where both begin a phrase at the same letter on they are the same.

        A segment without such a letter ends elsewhere than it was thought to, and the one after it is looked at again.
        """
        last = np.append(number[1:] == 0, True)
        pending = np.flatnonzero(number > 0)
        while len(pending):
            lane, place, changed = pending, end[pending - 1], []
            for i in range(SEGMENT):
                at = begin[lane] + i
                place = automaton.step(place, own[at])
                flag = (place & 1).astype(np.int8)
                met = (flag & begins[at]) == 1
                begins[at] = flag
                over = ~met & (width[lane] == i + 1)
                moved = over & (end[lane] != place)
                end[lane[moved]] = place[moved]
                changed.append(lane[moved])
                open_ = ~met & ~over
                lane, place = lane[open_], place[open_]
                if not len(lane):
                    break
            changed = np.concatenate(changed)
            pending = changed[~last[changed]] + 1

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text. Normalised phrases: count times log2 of the learned text's length, over the text's length: bits a letter."""
        if not self.languages:
            return [UNDEFINED] * len(texts), [0.0] * len(texts)
        letters, counts = self.phrases(texts)
        bits = counts * np.log2(np.array(self.sizes, dtype=float)) / np.maximum(letters, 1)[:, None]
        best = bits.argmin(axis=1)
        weights = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * np.minimum(letters, 50)[:, None] / 4)
        score = weights.max(axis=1) / weights.sum(axis=1)
        return [self.languages[b] if n else UNDEFINED for b, n in zip(best, letters, strict=True)], np.where(letters > 0, score, 0.0).tolist()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> CrossParser:
    """A parser learned from rows with a language and crc32(id) mod folds other than held_out.

    The sample is bounded: rows a language, chosen by a hash among those of at most TRAIN_TEXT_CHARS, as long as they make up at most TRAIN_CHARS
    together; each is taken whole. A language that has longer ones alone is learned from its shortest. The rows of each language are
    counted first; then a hash chooses a share that makes about twice the rows, so that few reach the driver whatever the size. No text is shuffled.
    """
    known = own_columns(docs, id=id_col, text=text_col, lang=lang_col).where(
        F.col("lang").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}")) & (crc_mod("id", folds) != held_out))
    known = known.select("lang", "text", F.length("text").alias("size"), F.xxhash64("id", "text").alias("key"))
    fits = F.col("size") <= TRAIN_TEXT_CHARS
    counts = known.groupBy("lang").agg(F.count_if(fits).alias("n"), F.min(F.struct("size", "key")).alias("least")).collect()  # a row a language, each of which becomes an automaton
    wanted = F.lit(False)
    for r in counts:
        few = fits & (F.pmod("key", F.lit(1 << 30)) < int(min(1.0, (2.0 * rows + 20) / max(1, r["n"])) * (1 << 30)))
        shortest = (F.col("size") == r["least"]["size"]) & (F.col("key") == r["least"]["key"])
        wanted = F.when(F.col("lang") == r["lang"], few if r["n"] else shortest).otherwise(wanted)
    taken: dict[str, list[str]] = {}
    for row in known.where(wanted).select("lang", "key", "text").distinct().orderBy("lang", "key").collect():
        texts = taken.setdefault(row["lang"], [])
        if not texts or (len(texts) < rows and sum(map(len, texts)) + len(row["text"]) <= TRAIN_CHARS):
            texts.append(row["text"])
    return CrossParser({lang: " ".join(texts) for lang, texts in taken.items()})


def portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in their order, at most BATCH at a time and BATCH_CHARS together; a longer one by itself."""
    part, chars = [], 0
    for text in texts:
        if part and (len(part) == BATCH or chars + len(text) > BATCH_CHARS):
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part


def judged(docs: DataFrame, parser: CrossParser, text_col: str = "text") -> DataFrame:
    """docs with a further column judged (lang_pred, score); the parser goes to each executor once, a bounded model."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [model.value.judge(part) for part in portions(texts.tolist())]
            yield pd.DataFrame({"lang_pred": [x for lang, _ in parts for x in lang], "score": [x for _, score in parts for x in score]})
        trim()

    return docs.withColumn("judged", judge(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def identify(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as id, lang_pred, score."""
    return judged(own_columns(docs, id=id_col, text=text_col), parser).select("id", "judged.lang_pred", "judged.score")


def in_a_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that are in no language: null texts and those without a letter. Where no language is learned, that is told by letters alone."""
    parser = learn(docs, id_col, text_col, lang_col)
    if not parser.languages:
        return docs.where(F.regexp_like(F.col(f"`{text_col}`"), F.lit(r"\p{L}")))
    with_index = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = f"c{docs.columns.index(text_col)}"
    kept = judged(with_index, parser, at).where(F.col("judged.lang_pred") != UNDEFINED)
    return kept.drop("judged").toDF(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select(F.col("id").alias("doc_id"), (crc_mod("id", 4) == 2).alias("held_out"), "lang_pred", "score")
