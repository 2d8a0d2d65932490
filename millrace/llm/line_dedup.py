"""Line dedup by site-relative frequency. DataFrame functions only.

A page with null html has no lines; a null url, or one without a host, counts to the host ''. Rows that repeat an id are
pages of their own. An empty table gives an empty result; a page whose lines all go keeps the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely, own_columns, table

#: A line goes if it stands on more than this share of its host's pages,
RATIO = 0.2
#: and on this many of them at least: a share of a few pages says nothing.
LEAST_PAGES = 3

#: What holds no text, tags that end a line, and the host within a URL.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\x20\x09-\x0D/][^>]*)?>"
TAG = r"<[A-Za-z/!][^>]*>"
BLANK = r"[\x20\x09\x0B\x0C\x0D]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """The visible lines: what block tags and newlines part, without tags, blanks collapsed, empty ones left out."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, ""), BLANK, " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_dedup(pages: DataFrame, host: Column, lines: Column, id_col: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """id, host, n_lines, n_dropped, text: each page's lines without those that are boilerplate of its host.

    A line counts once a page. Digests of lines are counted by (host, digest) with partial aggregates, so a line or a host that a
    third of all pages share is one row per task before the shuffle; the joins that carry rows have one row per key on
    the other side, so that adaptive execution can split hot keys. Of the pages' lines only those that may be boilerplate are
    shuffled, as places in their page, so the work is linear in a page's lines. Pages' text moves once, by a row number.
    """
    made = pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(host, F.lit("")).alias("host"), lines.alias("lines"))
    rows = table(made.withColumn("row", F.monotonically_increasing_id()), "lines")  # row is settled once written
    digests = F.transform("lines", lambda x: F.md5(x))
    once = rows.select("host", F.explode(F.array_distinct(digests)).alias("digest")).select("host", F.unhex("digest").alias("digest"))
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    counts = once.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, least_pages))
    boilerplate = table(counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "digest"), "boilerplate", small=True)
    each = rows.select("row", "host", F.posexplode(digests).alias("at", "digest")).withColumn("digest", F.unhex("digest"))
    dropped = likely(each, boilerplate, ["host", "digest"]).join(boilerplate, ["host", "digest"]).groupBy("row").agg(F.collect_list("at").alias("drop"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return (
        rows.join(dropped, "row", "left").withColumn("kept", kept)
        .select("id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
    )


def op6(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    named = own_columns(pages, page_id="page_id", url="url", html="html")
    return line_dedup(named, host_of(F.col("url")), lines_of(F.col("html")), "page_id").withColumnRenamed("id", "page_id")


OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS r, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{HIDDEN}', ' ', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), '{BLANK}', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
e AS (SELECT r, host, unnest(list_distinct(lines)) AS line FROM p),
t AS (SELECT host, count(*) AS total FROM p GROUP BY 1),
b AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM e GROUP BY 1, 2) JOIN t USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total),
d AS (SELECT r, list(line) AS gone FROM e JOIN b USING (host, line) GROUP BY 1),
k AS (SELECT page_id, host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept FROM p LEFT JOIN d USING (r))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
