"""Classifiers, language ID, packing, similarity joins, the embedding index and the pipeline, against plain Python or held-out rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common, embedding_dedup, jaccard, language, mixing, packing, quality, toxicity
from millrace.llm.common import table
from millrace.llm.queries import QUERIES

from . import brute
from .conftest import WORDS, prose
from .test_native import water_level

# --- packing -------------------------------------------------------------------


def hugging_face(text):
    from tokenizers import Tokenizer

    if not hasattr(hugging_face, "t"):
        hugging_face.t = Tokenizer.from_file(packing.tokenizer_path())
    return hugging_face.t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizers():
    encode, r = packing.fast_encoder(packing.tokenizer_path()), random.Random(1)
    odd = [" ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "​", "é", "é", "漢", "Ⅷ", "²", "_", "'s", "'ll", "a", "Z", "5", "٣", "😀", "<|endoftext|>", "!", "\x00", "ß"]
    for _ in range(4000):
        text = "".join(r.choice(odd) for _ in range(r.randrange(1, 14)))
        assert encode(text) == hugging_face(text)


def packed(df, capacity=64):
    return packing.pack(df, packing.tokenizer_path(), capacity=capacity).collect()


def assert_packs(rows, texts, capacity):
    """Round trip of pieces, no overlap, no gap, no bin too full."""
    pieces = sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    want = []
    for i, t in texts:
        ids = [*hugging_face(t), 2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        want += [(i, k, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())) for k, s in enumerate(starts) for part in [ids[s:starts[k + 1] if k + 1 < len(starts) else None]]]
    assert pieces == sorted(want, key=repr)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_on_hostile_rows(hostile, hostile_rows):
    n = assert_packs(packed(hostile), [(r[0], r[1]) for r in hostile_rows], 64)
    total = sum(len(hugging_face(r[1])) + 1 for r in hostile_rows)
    assert n <= -(-total // 64) + 3


def test_pack_empty(empty):
    assert packed(empty) == []


def test_minimum_bin_slack_is_near_the_bound():
    r = random.Random(4)
    lengths = [min(1024, max(1, int(r.lognormvariate(5.5, 1)))) for _ in range(3000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.minimum_bin_slack(histogram)
    used = {}
    for bins, combination in plan:
        assert bins > 0 and sum(n * k for n, k in combination.items()) <= 1024
        for n, k in combination.items():
            used[n] = used.get(n, 0) + k * bins
    assert used == histogram and sum(b for b, _ in plan) <= -(-sum(lengths) // 1024) + 2


def test_fullest_is_the_best_subset():
    r = random.Random(6)
    for _ in range(200):
        items = [(n, r.randrange(1, 4)) for n in r.sample(range(1, 30), 5)]
        capacity = r.randrange(1, 60)
        sums = {0}
        for n, c in items:
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= capacity}
        found = packing.fullest(items, capacity)
        assert sum(n * k for n, k in found.items()) == max(sums) and all(k <= dict(items)[n] for n, k in found.items())


# --- similarity join -------------------------------------------------------------


@pytest.mark.parametrize(("words", "percent", "parts", "differ"), [(3, 90, 3, 1), (5, 80, 1, 0), (2, 70, 4, 2)])
def test_signatures_lose_no_similar_pair(words, percent, parts, differ):
    r, bands = random.Random(words), jaccard.Bands(percent)
    common = np.sort(np.array([r.getrandbits(64) for _ in range(60)], dtype=np.uint64))
    sets = []
    for _ in range(300):
        base = [r.getrandbits(64) for _ in range(r.randrange(1, 90))] + r.sample(common.tolist(), r.choice([0, 0, 30]))
        sets.append(np.unique(np.array(base, dtype=np.uint64)))
        for _ in range(3):
            changed = [x if r.random() > 0.07 else r.getrandbits(64) for x in base] + [r.getrandbits(64) for _ in range(r.randrange(3))]
            sets.append(np.unique(np.array(changed, dtype=np.uint64)))
    signs = [set(s.tolist()) for s in jaccard.signatures(sets, bands, common, parts, differ)]
    as_sets, pairs = [set(s.tolist()) for s in sets], 0
    for i in range(len(sets)):
        for j in range(i - i % 4, i):
            both = len(as_sets[i] & as_sets[j])
            if as_sets[i] != as_sets[j] and 100 * both >= percent * (len(as_sets[i]) + len(as_sets[j]) - both):
                pairs += 1
                assert signs[i] & signs[j]
    assert pairs > 30


@pytest.mark.parametrize("unit", [200_000, 400])
def test_similar_groups_on_hostile_rows(hostile, hostile_rows, unit):
    rows = [(i, r) for i, r in enumerate(hostile_rows)]
    want = brute.jaccard_components([(i, r[1]) for i, r in rows])
    ids = dict(enumerate(r[0] for r in hostile_rows))
    least = {}
    for i, (_, root) in want.items():
        if ids[i] is not None:
            least[root] = min(least.get(root, ids[i]), ids[i])
    expected = sorted(((ids[i], n, least.get(root) if n else ids[i]) for i, (n, root) in want.items()), key=repr)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(hostile, unit=unit).collect()), key=repr)
    assert got == expected


def test_similar_groups_equals_brute_force_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for words, percent in ((3, 90), (5, 80)):
        want = brute.jaccard_components(rows, words, percent)
        assert {r.id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, words, percent).collect()} == want


def test_a_chain_of_loose_near_copies_costs_what_shares_a_signature(spark, monkeypatch):
    """Each text is similar to its neighbours alone: one component, exact. Twice the chain is compared in twice the rows, not four times."""
    words = [f"w{i}" for i in range(4_000)]
    compared, own = [], jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda units, *rest: compared.append(units.count()) or own(units, *rest))
    for n in (300, 600):
        rows = [(k, " ".join(words[2 * k:2 * k + 60])) for k in range(n)]
        got = {r.id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), unit=1_000).collect()}
        assert set(got.values()) == {0}
    within, across, within2, across2 = compared
    assert within2 <= 2.2 * within and across2 <= 2.3 * across


def test_similar_groups_empty(empty):
    assert jaccard.similar_groups(empty).count() == 0


# --- embeddings ------------------------------------------------------------------


def near_pairs(rows, cosine=0.93):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= cosine]


@pytest.mark.parametrize("unit_rows", [2000, 7])
def test_near_groups(spark, unit_rows):
    r = np.random.default_rng(3)
    rows, centre = [], r.normal(size=(6, 16))
    for i in range(240):
        rows.append((i, (centre[i % 6] + r.normal(size=16) * (0.05 if i % 3 else 1.0)).tolist(), i % 2))
    rows += [(300 + k, rows[1][1], 1) for k in range(12)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e-30] * 16, [1e-30] * 16]
    rows += [(400 + k, v, 1) for k, v in enumerate(bad)] + [(500, rows[1][1], None), (501, [1.0, 2.0], 1), (502, [1.0, 2.01], 1)]
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], "vec_id long, embedding array<double>, label int, node string, copies int").repartition(3)
    got = {x.id: (x.n_links, x.component_id) for x in embedding_dedup.near_groups(df, unit_rows=unit_rows).collect()}
    pairs = near_pairs(rows)
    roots, links = brute.closure([x[0] for x in rows], pairs), {x[0]: 0 for x in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert all(got[i][0] <= links[i] for i in links)  # never a link below the cosine
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(links.values())
    assert sum(got[i][1] == roots[i] for i in roots) >= 0.97 * len(roots)


def test_op10_on_a_planted_table(spark, tmp_path):
    """The registered query: contract columns, no link below the cosine, recall of links and components over 0.9."""
    r = np.random.default_rng(11)
    rows, n = [], 0
    for c in range(250):
        centre = r.normal(size=48)
        for _ in range(int(r.integers(1, 8))):
            rows.append((n, (centre + r.normal(size=48) * 0.25).astype(np.float32).tolist(), ["a", "b", None][c % 3]))
            n += 1
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op10_embedding_dedup"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    got = {x.vec_id: x for x in out.collect()}
    pairs = near_pairs(rows)
    links = dict.fromkeys(got, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    roots = brute.closure([x[0] for x in rows], pairs)
    assert len(got) == len(rows) and sum(links.values()) > 400 and all(got[i].n_links <= links[i] for i in links)
    assert sum(x.n_links for x in got.values()) >= 0.9 * sum(links.values())
    assert sum(got[i].component_id == roots[i] for i in roots) >= 0.95 * len(roots)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_pivots_stand_apart():
    r = np.random.default_rng(5)
    x = embedding_dedup.unit(np.concatenate([r.normal(size=(1500, 8)), np.repeat(r.normal(size=(3, 8)), 500, axis=0)]))
    taken = embedding_dedup.spread(x, 100)
    slow: list = []
    for v in x:
        if len(slow) < 100 and all(v @ t < embedding_dedup.APART for t in slow):
            slow.append(v)
    assert np.allclose(taken, np.array(slow))


def test_near_groups_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_groups(df).count() == 0


# --- language ----------------------------------------------------------------------


def test_suffix_automaton_knows_all_substrings():
    r = random.Random(1)
    codes = [r.randrange(3) for _ in range(60)]
    step = language.suffix_automaton(codes)

    def known(s):
        state = 0
        for c in s:
            state = step[state].get(c)
            if state is None:
                return False
        return True

    every = {tuple(codes[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    assert all(known(s) for s in every)
    assert all(known(s) == (s in every) for s in {tuple(r.randrange(3) for _ in range(5)) for _ in range(200)})


def greedy(codes, learned):
    count, i = 0, 0
    text = "".join(map(chr, learned))
    while i < len(codes):
        n = 1
        while i + n < len(codes) and "".join(map(chr, codes[i:i + n + 1])) in text:
            n += 1
        count, i = count + 1, i + n
    return count


def test_phrases_equal_greedy_parsing():
    r = random.Random(2)
    learned = {"x": prose(r, 120, WORDS[:9]), "y": prose(r, 90, WORDS[9:])}
    parser = language.CrossParser(learned)
    texts = [prose(r, 20), "", "alpha", "9 9", prose(r, 60, WORDS[9:]), "ÄÖ alpha"]
    _, counts = parser.phrases(texts)
    for t, got in zip(texts, counts, strict=True):
        codes = parser.encode(parser.fold(t)).tolist()
        assert got.tolist() == [greedy(codes, parser.encode(parser.fold(learned[k])).tolist()) if codes else 0 for k in ("x", "y")]


def test_long_texts_are_parsed_whole(monkeypatch):
    """The greedy parse of the whole text, whatever the segments: also where one phrase runs through many of them, and with letters beyond the table."""
    r = random.Random(3)
    monkeypatch.setattr(language, "SEGMENT", 16)
    monkeypatch.setattr(language, "DENSE", 6)
    learned = {"x": prose(r, 200, WORDS[:9]), "y": prose(r, 200, WORDS[9:]) + "漢字かな" * 9}
    parser = language.CrossParser(learned)
    texts = [prose(r, 3, WORDS[:9]) + " " + prose(r, 400, WORDS[9:]), learned["x"], learned["y"][100:] + learned["x"][:300], "字かな漢" * 40 + "漢漢", prose(r, 300, WORDS[:9]), "Ω" * 100, learned["x"][7:] * 2]
    _, counts = parser.phrases(texts)
    for t, got in zip(texts, counts, strict=True):
        codes = parser.encode(parser.fold(t)).tolist()
        assert got.tolist() == [greedy(codes, parser.encode(parser.fold(learned[k])).tolist()) for k in ("x", "y")]
    assert counts[1][0] == 1 and counts[2][1] > 1
    assert parser.judge([texts[0], texts[4]])[0] == ["y", "x"]


def test_parsers_of_many_letters_stay_small():
    import pickle
    import tracemalloc

    r = random.Random(4)
    texts = {f"l{k}": "".join(chr(0x4E00 + r.randrange(15_000)) for _ in range(12_000)) for k in range(10)}
    tracemalloc.start()
    parser = language.CrossParser(texts)
    sent = pickle.dumps(parser)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and len(sent) < 40 << 20
    assert pickle.loads(sent).judge([texts["l3"][500:900], texts["l7"][-50:]])[0] == ["l3", "l7"]


def test_parsers_take_memory_by_their_edges():
    """A worker holds four full languages in 24 MB (a table of all states by letters took 60 and more) and the letters of a bounded portion of texts."""
    import pickle
    import tracemalloc

    r = random.Random(5)
    alphabet = [chr(97 + k) for k in range(26)] + ["\u00e4", "\u00e9", "\u00f1", "\u00f8", "\u00fc", "\u00df"] + [" "] * 6
    sent = pickle.dumps(language.CrossParser({f"l{k}": "".join(r.choices(alphabet, [r.random() ** 3 for _ in alphabet], k=78_000)) for k in range(4)}))
    tracemalloc.start()
    parser = pickle.loads(sent)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(parser.languages) == 4 and held < 24 << 20
    texts = ["a" * n for n in (5, 0, language.BATCH_CHARS + 7, 3, language.BATCH_CHARS - 2, 2)] + ["b"] * 1_500
    parts = list(language.portions(texts))
    assert [t for part in parts for t in part] == texts
    assert all(len(part) == 1 or len(part) <= language.BATCH and sum(map(len, part)) <= language.BATCH_CHARS for part in parts) and len(parts) <= 8


@pytest.mark.parametrize("dense", [2, 48])
def test_packed_rows_keep_all_states_apart(monkeypatch, dense):
    """Each cell of a row is its state's alone, no two states begin at the same place, and none without edges meets a cell."""
    monkeypatch.setattr(language, "DENSE", dense)
    r = random.Random(6)
    rows = {p: sorted(r.sample(range(300), r.choice([0, 1, 1, 1, 2, 3, 40, 290]))) for p in range(700)}
    states, letters = np.array([(p, c) for p, row in rows.items() for c in row]).T
    where, end = language.packed_rows(states, letters, 700)
    cells = where[states] + letters
    assert len(set(cells.tolist())) == len(cells) and cells.max() < end
    with_edges = [p for p, row in rows.items() if row]
    assert len(set(where[with_edges].tolist())) == len(with_edges)
    assert all(where[p] == end for p, row in rows.items() if not row)


def test_sample_takes_rows_whole(spark):
    """By hash among the rows that fit; a language with longer ones alone is learned from its shortest."""
    rows = [(i, "kurz " * (i % 7 + 1), "a") for i in range(500)] + [(1000 + i, "lang" * (6_000 + i), "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = language.learn(docs, rows=10)
    learnable = {i for i, _, _ in rows if brute.crc_mod(i, 4) != 2}
    assert parser.languages == ["a", "b"] and parser.sizes[1] == min(len(t) for i, t, lang in rows if lang == "b" and i in learnable)
    assert parser.judge(["kurz kurz", "langlang"])[0] == ["a", "b"]


def test_language_on_hostile_rows(hostile, hostile_rows, empty):
    parser = language.learn(hostile)
    out = language.identify(hostile, parser).collect()
    assert len(out) == len(hostile_rows) and all(0 <= r.score <= 1 for r in out)
    no_letter = {r[0] for r in hostile_rows if r[0] is not None and not any(c.isalpha() for c in r[1] or "")}
    assert {r.id for r in out if r.lang_pred == "und" and r.id is not None} == no_letter
    kept = language.in_a_language(hostile)
    assert kept.columns == hostile.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in hostile_rows)
    assert language.identify(empty, language.learn(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(hostile, language.CrossParser({})).collect()} == {"und"}


def test_language_without_labels_keeps_texts_with_letters(hostile, hostile_rows):
    """No lang at all, and lang on held-out rows alone: nothing is learned, and no text with a letter goes."""
    want = sum(any(c.isalpha() for c in r[1] or "") for r in hostile_rows)
    held_out = F.when(language.crc_mod("doc_id", 4) == 2, F.lit("en"))
    for lang in (F.lit(None).cast("string"), held_out):
        kept = language.in_a_language(hostile.withColumn("lang", lang))
        assert kept.columns == hostile.columns and kept.count() == want


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op4_language"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, total = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * total


# --- classifiers -------------------------------------------------------------------


def labelled_rows(n=600):
    """Good texts in prose; bad ones with marks between words; some with an insult."""
    r, docs, labels = random.Random(9), [], []
    for i in range(n):
        words, bad, rude = prose(r, r.randrange(20, 80)).split(), i % 4 == 0, i % 5 == 1
        if bad:
            words = [w + r.choice(["$$$", "%%%", " |"]) for w in words]
        if rude:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["nitwit", "blockhead"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    return docs, labels


@pytest.mark.parametrize(("label", "score"), [("quality", quality.quality), ("toxic", toxicity.toxicity)])
def test_classifier_on_held_out_rows(spark, label, score):
    docs, labels = labelled_rows()
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {x[0]: x[1 if label == "quality" else 2] for x in labels}
    out = {r.id: r.score for r in score(d, l).collect()}
    held = [i for i in truth if brute.crc_mod(i, 5) == 0]
    assert len(out) == len(docs) and np.mean([(out[i] >= 0.5) == truth[i] for i in held]) >= 0.95
    assert out == {r.id: r.score for r in score(d, l).collect()}  # reruns agree


@pytest.mark.parametrize("score", [quality.quality, lambda d, l: toxicity.toxicity(d, l, label="quality")])
def test_classifier_on_hostile_rows(spark, hostile, hostile_rows, empty, score):
    labels = spark.createDataFrame([(i, [0, 1, None][i % 3], "t") for i in range(60)] + [(None, 1, "t"), (99999, 0, "t"), (3, 0, "t")], "doc_id long, quality int, text string")
    rows = score(hostile, labels).collect()
    assert len(rows) == len(hostile_rows) and all(0 <= r.score <= 1 for r in rows)
    assert score(empty, labels).count() == 0
    assert len({r.score for r in score(hostile, labels.limit(0)).collect()}) == 1


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = labelled_rows(300)
    flipped = [(i, 1 - q if brute.crc_mod(i, 5) == 0 else q, t) for i, q, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = ({r.id: r.score for r in quality.quality(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_word_vectors_are_neighbours_index_vectors(spark):
    """By hand over a few words, before centring and scaling: same direction of differences."""
    texts = ["a b c", "c b a a"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    columns, signs = quality.index_vectors()
    index = np.zeros((quality.ROWS, quality.DIMENSIONS))
    np.put_along_axis(index, columns, signs, axis=1)
    want, ids = np.zeros_like(index), quality._Ids()
    for t in texts:
        rows = [ids[w] for w in t.split()]
        for i, w in enumerate(rows):
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                if j != i:
                    want[w] += index[rows[j]]
    seen = sorted({ids[w] for w in "abc"})
    unit = want[seen] / np.linalg.norm(want[seen], axis=1, keepdims=True)
    assert np.allclose(got[seen], unit - unit.mean(axis=0), atol=1e-6)


def test_grams_are_the_character_grams():
    """Equal grams, and as good as no others, share a bucket; a text has each once."""
    texts = ["Ab  ab\tÄb", "xyz", "", "ab"]
    owner, bucket = toxicity.present(texts)
    of = lambda gram: set(toxicity.grams([gram])[1].tolist())
    for i, text in enumerate(texts):
        folded = " " + " ".join(text.lower().split()) + " "
        plain = {folded[k:k + n] for n in (3, 4, 5) for k in range(len(folded) - n + 1)}
        assert len(bucket[owner == i]) == len(plain)
    assert set(bucket[owner == 3].tolist()) < set(bucket[owner == 0].tolist()) | of("ab")


def test_densities_against_plain_counts():
    """Occurrences by length, of wanted grams alone; an empty text has none."""
    texts = ["abab ab", "", "xyz " * 40 + "ab"]
    wanted = np.zeros(1 << toxicity.BITS, dtype=bool)
    gram = " ab"
    at = toxicity.grams(["ab"])[1][0]  # the first three characters of ' ab '
    wanted[at] = True
    owner, bucket, value = toxicity.densities(texts, wanted)
    assert owner.tolist() == [0, 2] and set(bucket.tolist()) == {at}
    for i, got in zip(owner, value, strict=True):
        folded = " " + " ".join(texts[i].lower().split()) + " "
        n = sum(folded[k:k + 3] == gram for k in range(len(folded)))
        length = sum(len(folded) - order + 1 for order in toxicity.ORDERS) / len(toxicity.ORDERS)
        assert got == pytest.approx(np.log1p(toxicity.PER * n / (length + toxicity.LENGTH_PRIOR)))


def test_log_count_ratios_by_hand():
    counts = np.zeros((2, 8))
    counts[:, 0], counts[:, 1], counts[:, 2] = (2, 20), (20, 2), (3, 3)
    ratio, wanted = toxicity.log_count_ratios(counts)
    total = counts.sum(axis=1) + 8
    assert ratio[0] == pytest.approx(np.log(21 / total[1]) - np.log(3 / total[0])) and wanted.tolist()[:3] == [True, True, False]


def written(spark, folder, docs, labels=None):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    if labels:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize(("name", "cut", "column"), [("op1_quality", 0.3, 1), ("op3_toxicity", 0.5, 2)])
def test_classifier_queries_keep_their_contract(spark, tmp_path, name, cut, column):
    docs, labels = labelled_rows(400)
    folder = written(spark, tmp_path, [(i, t, "en", "s") for i, t in docs] + [(9000, None, None, None), (9001, "", None, None)], labels)
    out = QUERIES[name](spark, folder)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [*range(400), 9000, 9001]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) and r.held_out == (brute.crc_mod(r.doc_id, 5) == 0) for r in rows)
    truth = {x[0]: x[column] for x in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9


def test_op4_op5_and_op7_keep_their_contracts(spark, tmp_path):
    r = random.Random(21)
    docs = [(i, prose(r, r.randrange(1, 60)), "en", "s") for i in range(30)] + [(40, None, None, None), (41, "1 2", "en", "s"), (42, prose(r, 900), "en", "s")]
    docs += [(50, docs[3][1].upper(), "en", "s"), (51, docs[42 - 10][1] + " tail", "en", "s")]
    folder = written(spark, tmp_path, docs)
    language_rows = QUERIES["op4_language"](spark, folder)
    assert dict(language_rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    assert all(x.held_out == (brute.crc_mod(x.doc_id, 4) == 2) and (x.lang_pred == "und") == (x.doc_id in (40, 41)) for x in language_rows.collect())
    packed_rows = QUERIES["op5_pack"](spark, folder)
    assert {k: v for k, v in packed_rows.dtypes if k != "piece"} == dict.fromkeys(("start", "length", "ids_crc32", "sequence_id", "offset", "doc_id"), "bigint") and dict(packed_rows.dtypes)["piece"] == "int"
    assert_packs(packed_rows.withColumnRenamed("doc_id", "id").collect(), [(d[0], d[1]) for d in docs], 1024)
    joined = QUERIES["op7_jaccard_join"](spark, folder)
    assert dict(joined.dtypes) == dict.fromkeys(("doc_id", "n_shingles", "component_id"), "bigint")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in joined.collect()} == brute.jaccard_components([(d[0], d[1]) for d in docs])


# --- pipeline ----------------------------------------------------------------------


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "mix_sources", "pack"]


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for (name, stage), step in zip(corpus_pipeline.STAGES[:3], ("letters", "equal", "similar"), strict=False):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        if step == "letters":
            kept = {i: t for i, t in kept.items() if any(c.isalpha() for c in t or "")}
        elif step == "equal":
            first = {}
            for i in sorted(kept):
                first.setdefault(brute.normalised(kept[i]), i)
            kept = {i: kept[i] for i in first.values()}
        else:
            roots = brute.jaccard_components(list(kept.items()), 5, 80)
            kept = {i: t for i, t in kept.items() if roots[i][1] == i}
        assert {r.doc_id: r.text for r in docs.collect()} == kept, name
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    texts = [(r.doc_id, r.text) for r in mixed.collect()]
    assert all(kept[i].startswith(t) for i, t in texts) and mixed.columns == columns
    assert_packs(corpus_pipeline.pack_sequences(spark, mixed, sf_dir).withColumnRenamed("doc_id", "id").collect(), texts, 1024)


def test_pipeline_on_hostile_rows(spark, hostile_rows):
    """Stage by stage on rows with null ids, ids that repeat with other texts and repeated rows: exact in content, count and budget."""
    short = [r for r in hostile_rows if len(r[1] or "") < 50_000]
    extra = [(5, "alpha beta one text alone", "en", "s1"), (5, "another text of its own", "en", "s2"), (None, "no id and a text of its own", "en", "s1"), (None, "no id and a text of its own", "en", "s1")]
    rows = [(r[0], r[1], r[2], r[3], 1, "x", 2) for r in short] + [(*r, 1, "x", 2) for r in extra]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _mix_row string, _place int").repartition(3)
    columns = docs.columns
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    want = [(r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or "")]
    docs = table(corpus_pipeline.identify_language(spark, docs, ""), "one")
    assert pairs(docs) == sorted(want, key=repr) and docs.columns == columns
    docs = table(corpus_pipeline.drop_copies(spark, docs, ""), "two")
    assert sorted(((i, brute.normalised(t)) for i, t in pairs(docs)), key=repr) == brute.first_copies(want) and docs.columns == columns
    want = pairs(docs)
    docs = table(corpus_pipeline.drop_near_copies(spark, docs, ""), "three")
    assert [i for i, _ in pairs(docs)] == [i for i, _ in brute.first_of_groups(want, 5, 80)] and set(pairs(docs)) <= set(want) and docs.columns == columns
    words = lambda t: len(t.encode().split())
    sizes, taken = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    docs = table(corpus_pipeline.mix_sources(spark, docs, ""), "four")
    for r in docs.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    goal = water_level(sizes, mixing.WEIGHTS, mixing.EPOCHS)
    assert {s: int(g) for s, g in goal.items() if g >= 1} == taken and docs.columns == columns
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert_packs(corpus_pipeline.pack_sequences(spark, docs, "").withColumnRenamed("doc_id", "id").collect(), texts, 1024)


def test_pipeline_deletes_its_scratch(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len([p for p in tmp_path.rglob("*") if p.is_dir() and any(p.glob("*.parquet"))]) == 1


def test_pipeline_on_an_empty_table(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
