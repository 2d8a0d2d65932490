"""PII: patterns, and terms whose co-occurrence with an entity discloses it. DataFrame functions only.

Null text counts as empty and has no spans. Rows that repeat an id are documents of their own. An empty table gives an
empty result. Very long texts are scanned whole: the patterns take time linear in the text; masking, contexts and sanitised texts take a
substring for each span, so time that goes with the length times the spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely, place, settled, table

#: Kinds in their order, and patterns. The patterns match the same as the plain ones of the
#: contract; possessive quantifiers and looking behind only spare them retries and deep recursion.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}[\p{L}\p{N}]*+"

#: What a term can reveal: the kind of a span, its group (an address's domain, an ip's first two parts, the first digits of a card or phone), and the
#: very entity. Digits that make a group:
CARD_GROUP, PHONE_GROUP = 6, 4
#: Words to either side of a mention that are its context: copies of a passage are one context, however many documents have it.
CONTEXT_WORDS = 4
CONTEXT = r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){0,%d}+" % CONTEXT_WORDS
#: Share of a class's information that a term must disclose.
THRESHOLD = 0.5
#: Bounds on counts are kept this much wide of the exact ones, as they are computed in floating point.
SLACK = 1 + 1e-9
#: Parts of a text that positions takes at a time.
BLOCK = 512


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def positions(text: Column, pattern: str, found: Column, wanted) -> Column:
    """array of (start, end, value) of those of found = matches(text, pattern) that are wanted; code points from 0, end exclusive.

    What stands between matches, and the matches, add up to the text: places are running sums of their lengths.
    """
    parts = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["match"]), F.lit(0)).alias("match"), x["match"].alias("value")),
    )
    spans = "array<struct<start:int,end:int,value:string>>"
    wide = lambda part: part["gap"] + part["match"]

    def step(seen: Column, part: Column) -> Column:
        start = seen["at"] + part["gap"]
        span = F.struct(start.alias("start"), (start + part["match"]).alias("end"), part["value"].alias("value"))
        good = part["value"].isNotNull() & wanted(part["value"])
        return F.struct((seen["at"] + wide(part)).alias("at"), F.when(good, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"))

    # arrays only grow by copying: blocks of parts, and one running sum over the blocks, keep that linear
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(found) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, part: n + wide(part)))
    offsets = F.aggregate(widths, F.array(F.lit(0)), lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)))
    placed = F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(widths)), lambda block, at: F.aggregate(
        block, F.struct(at.alias("at"), F.array().cast(spans).alias("spans")), step, lambda seen: seen["spans"]))
    return F.when(F.exists(found, wanted), F.flatten(placed)).otherwise(F.array().cast(spans))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def ip_ok(value: Column) -> Column:
    def part(x: Column) -> Column:
        x = F.ltrim(x, F.lit("0"))
        return F.when(F.length(x) <= 3, F.coalesce(x.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), part)


def card_ok(value: Column) -> Column:
    d = digits(value)

    def luhn(number: Column) -> Column:
        terms = F.transform(F.split(F.reverse(number), ""), lambda x, i: F.when(x == "", 0).when(i % 2 == 1, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int") + 1)).otherwise(x.cast("int")))
        return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0

    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def phone_ok(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """One struct of four arrays of matches; the text is scanned for a kind only if it has a character that the kind needs."""
    def if_has(test: Column, pattern: str) -> Column:
        return F.when(test, matches(text, pattern)).otherwise(F.array().cast("array<string>"))

    digit = F.regexp_like(text, F.lit("[0-9]"))
    return F.struct(
        if_has(F.contains(text, F.lit("@")), EMAIL).alias("email"),
        if_has(digit & F.contains(text, F.lit(".")), IP).alias("ip"),
        if_has(digit, CARD).alias("card"),
        if_has(F.contains(text, F.lit("+")), PHONE).alias("phone"),
    )


def with_kind(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def masked(text: Column, spans: Column) -> Column:
    """text of the same length without letters in spans, which are in order: no part of a span is a term."""
    def step(done: Column, s: Column) -> Column:
        out = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.repeat(F.lit("."), s["end"] - F.greatest(s["start"], done["at"])))
        return F.when(s["end"] > done["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(done)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def classes_of(span: Column) -> Column:
    """Names of what a term near the span could reveal: its kind, its group, and the entity itself."""
    kind, value, number = span["kind"], F.lower(span["value"]), digits(span["value"])
    group = F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 2)).when(kind == 2, F.left(number, F.lit(CARD_GROUP))).otherwise(F.left(number, F.lit(PHONE_GROUP)))
    entity = F.when(kind <= 1, value).otherwise(number)
    return F.array(kind.cast("string"), F.concat(kind.cast("string"), F.lit("|"), group), F.concat(kind.cast("string"), F.lit(":"), entity))


def terms_of(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(matches(text, TERM), F.lower))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, base: array of (start, kind, end, value); and of texts with any: masked, the text without base, words, its terms, and met, array of (class, context), one for each class of base, by its first mention."""
    text = F.col("text")
    docs = settled(docs)
    d = docs.select(place(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    d = d.withColumn("m", base_spans(text))
    checks = {"email": (EMAIL, lambda v: F.lit(True)), "ip": (IP, ip_ok), "card": (CARD, card_ok), "phone": (PHONE, phone_ok)}
    for kind, (pattern, wanted) in checks.items():
        number = KINDS.index(kind)
        spans = positions(text, pattern, F.col(f"m.{kind}"), wanted)
        d = d.withColumn(kind, with_kind(spans, number))
    d = d.select("row", "id", "text", F.array_sort(F.concat("email", "ip", "card", "phone")).alias("base"))
    d = d.withColumn("masked", F.when(F.size("base") > 0, masked(text, F.col("base"))))

    def around(span: Column) -> Column:
        """Hash of the nearest words before and after: what is before is read backwards."""
        before = F.regexp_extract(F.reverse(F.substring("masked", 1, span["start"])), CONTEXT, 0)
        after = F.regexp_extract(F.substring("masked", span["end"] + 1, F.length("masked")), CONTEXT, 0)
        return F.xxhash64(before, after)

    mentions = F.flatten(F.transform("base", lambda s: F.transform(classes_of(s), lambda c: F.struct(c.alias("class"), s["start"].alias("start"), s["end"].alias("end")))))
    d = d.withColumn("mentions", F.when(F.size("base") > 0, mentions)).withColumn("names", F.array_distinct("mentions.class"))
    first = F.transform("names", lambda c: F.element_at("mentions", F.array_position("mentions.class", c).cast("int")))
    d = d.withColumn("first", first).withColumn("words", terms_of(F.col("masked")))
    met = F.transform("first", lambda m: F.struct(m["class"].alias("class"), around(m).alias("context")))
    return table(d.select("row", "id", "base", "masked", "words", met.alias("met")), "found")


def _met(found: DataFrame) -> DataFrame:
    """(row, class, context): a row for each document and class in it."""
    return found.where(F.size("base") > 0).select("row", F.explode("met").alias("m")).select("row", "m.class", "m.context")


def _words(found: DataFrame) -> DataFrame:
    """(row, term): a row for each different term of a document with personal data."""
    return found.where(F.size("base") > 0).select("row", F.explode("words").alias("term"))


def disclosing(docs: DataFrame, found: DataFrame, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(class, term, n_met, n_term, n_class, disclosure) of the pairs over the threshold, by documents of the whole corpus.

    A term meets all classes of the documents that it is in, wherever both stand. With p = n_met / n_term, the share of the term's
    documents that have the class, and q = n_class / D: disclosure = PMI / IC = log(p / q) / log(1 / q), 1 where the term occurs
    with the class alone. n_met is the effective number of the class's contexts in documents with the term, (sum n)^2 / sum n^2 over contexts in n
    documents: all of them where each is different, about one where copies of a passage outnumber the rest, however their edges were edited.

    A share of few documents may be chance. The evidence, n_term KL(p, q) in bits, has to be more than the bits that name one of all
    (term, class) meetings, log M: so less than about one pair is taken by chance, whatever the size of the corpus, and there is no least count.
    Evidence is at most n_met log(1 / q), and a share p that discloses enough is at least q ^ (1 - threshold), so a term of a pair is in at most
    n_class ^ threshold D ^ (1 - threshold) documents. Classes and terms that cannot reach that are left out before pairs are made, without loss:
    words that stand once, and words that stand everywhere. All counts have partial aggregates before their shuffle.
    """
    sizes = found.agg(F.count("*"), F.sum(F.size("words").cast("double") * F.size("met"))).first()
    total, needed = float(sizes[0]), math.log2(max(2.0, float(sizes[1] or 0)))
    ic = F.log2(F.lit(total) / F.col("n_class"))
    most = F.pow(F.col("n_class").cast("double"), F.lit(threshold)) * total ** (1 - threshold)
    met, words = _met(found), _words(found)
    classes = met.groupBy("class", "context").agg(F.count("*").alias("n")).groupBy("class").agg(F.sum("n").alias("n_class"), F.count("*").alias("contexts"))
    classes = table(classes.where((F.col("n_class") < total) & (F.col("contexts") * ic > needed)).select("class", "n_class", ic.alias("ic"), most.alias("most")), "classes", small=True)
    best, longest = classes.agg(F.max("ic"), F.max("most")).first()
    # terms that could be in a pair: in enough documents with personal data, and in few enough of the corpus
    some = words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") * (best or 0.0) > needed)
    some = table(some.select("term"), "some", small=True)
    corpus = docs.select(F.explode(terms_of(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("term"))
    n_term = likely(corpus, some, ["term"]).groupBy("term").agg(F.count("*").alias("n_term"))
    # a term that is one only beside a masked span is in no text of its own: its count is raised below
    terms = some.join(n_term, "term", "left").select("term", F.coalesce("n_term", F.lit(0)).alias("n_term")).where(F.col("n_term") <= SLACK * (longest or 0.0))
    terms = table(terms, "terms", small=True)
    held = likely(words, terms, ["term"]).join(terms, "term")
    known = likely(met, classes, ["class"]).join(classes, "class")
    each = held.join(known, "row").where(F.col("n_term") <= SLACK * F.col("most")).select("class", "term", "context", "n_class", "n_term")
    counted = each.groupBy("class", "term", "context").agg(F.count("*").alias("n"), F.max("n_class").alias("n_class"), F.max("n_term").alias("n_term"))
    n = F.col("n").cast("double")
    out = counted.groupBy("class", "term").agg((F.sum(n) * F.sum(n) / F.sum(n * n)).alias("n_met"), F.max("n_class").alias("n_class"), F.max("n_term").alias("n_term"))
    out = out.withColumn("n_term", F.greatest("n_term", "n_met"))
    p, q = F.col("n_met") / F.col("n_term"), F.col("n_class") / F.lit(total)
    rest = F.when(p < 1, (1 - p) * F.log2((1 - p) / (1 - q))).otherwise(0.0)
    evidence = F.col("n_term") * (p * F.log2(p / q) + rest)
    out = out.where((p > q) & (evidence > needed)).withColumn("disclosure", F.log2(p / q) / F.log2(1 / q))
    return out.where(F.col("disclosure") >= threshold).select("class", "term", "n_met", "n_term", "n_class", "disclosure")


def _spans(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """pii_spans, with row: the place of each row of docs, which is settled."""
    found = _found(docs, id_col, text_col)
    marked = table(disclosing(docs, found, text_col, threshold).select("class", "term"), "marked", small=True)
    held = likely(_words(found), marked, ["term"]).join(marked, "term")
    met = likely(_met(found), marked, ["class"]).select("row", "class")
    marks = held.join(met, ["row", "class"]).groupBy("row").agg(F.collect_set("term").alias("marks"))
    marks = table(marks, "marks", small=True)
    every = positions(F.col("masked"), TERM, matches(F.col("masked"), TERM), lambda v: F.array_contains(F.col("marks"), F.lower(v)))
    more = F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))
    places = likely(found.select("row", "masked"), marks, ["row"]).join(marks, "row").select("row", more.alias("more"))
    both = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return found.select("row", "id", "base").join(places, "row", "left").select("row", "id", "base", both.alias("spans"))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, base and spans, arrays of (start, kind, end, value) in order; kind is a place in KINDS, spans has the terms too.

    A term is a span wherever it stands in a document that has a class which it discloses, not in others: documents without personal data stay as they are.
    """
    return _spans(settled(docs), id_col, text_col, threshold).drop("row")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id and text with base spans generalised to their kind, as [EMAIL], and disclosing terms removed; one row per row of docs, whatever their ids."""
    docs = settled(docs)
    spans = _spans(docs, id_col, text_col, threshold).select("row", "id", "spans")
    text = F.col("text")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:-1]], F.lit(""))

    def step(done: Column, s: Column) -> Column:
        kept = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.element_at(names, s["kind"] + 1))
        return F.when(s["start"] >= done["at"], F.struct(s["end"].alias("at"), kept.alias("out"))).otherwise(F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out")))

    end = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    made = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)
    texts = docs.select(place(docs).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(spans, "row").select("id", made.alias("text"))


def op9(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:-1]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") > 0).alias("has_pii"))
