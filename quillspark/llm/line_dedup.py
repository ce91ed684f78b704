"""Boilerplate lines by their frequency within a site.

Pages are grouped by site, which is the host of their URL where they have one
(``host_of``).  A line's frequency is the number of the site's pages that contain
it, divided by the number of the site's pages; lines over the ratio are boilerplate
and are dropped from every page of that site.  A line on a single page (fewer than
``min_pages``) repeats nothing and stays, whatever the size of its site.  Different
lines of a page count once each; a share of exactly the ratio is not over it.

Counts combine before the shuffle, so neither a hot host nor a hot line gathers in
one task.  The boilerplate of a site has at most (lines of its average page) / ratio
entries, one array per site.  All of it is measured: up to ``BROADCAST_BYTES`` it is
broadcast and pages don't move; beyond, pages and arrays are joined by site and
salt, so that a hot site spreads over many tasks.  Pages are filtered in place.

Null texts stay null; a null site is a site of its own; a page may end up empty, and
an empty table gives no rows.  Repeated rows count as pages of their own.  White
space at the ends of a line does not tell lines apart, and blank lines are never
boilerplate.  Columns of the input are kept, also ones named like those used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table
from quillspark.operators.ingest import extract_pages

RATIO, MIN_PAGES = 0.1, 2
#: Boilerplate of all sites that is broadcast at most, and tasks that a site's pages are spread over beyond.
BROADCAST_BYTES, SALTS = 32 << 20, 64
BLANKS = " \t\r\f\v"


def host_of(url: Column) -> Column:
    """Host of a URL, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def boilerplate(pages: DataFrame, site: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(site, lines)``: for every site that has any, the array of its boilerplate lines."""
    seen = pages.select(site.alias("site"), F.array_distinct(F.transform(F.split(F.col(text_col), "\n", -1), _key)).alias("own"))
    totals = seen.groupBy("site").agg(F.count("*").alias("pages"))
    # The outer form: for the inner one Spark filters by the size of the array first and builds it twice.
    lines = seen.select("site", F.explode_outer("own").alias("line")).where("line <> ''").groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = lines.join(totals, lines["site"].eqNullSafe(totals["site"])).where(F.col("n") > F.lit(ratio) * F.col("pages")).select(lines["site"], "line")
    return often.groupBy("site").agg(F.collect_list("line").alias("lines"))


def _joined(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages(site, page)`` with the ``lines`` of their site (null: none)."""
    same = F.col("site").eqNullSafe(F.col("its"))
    size = found.agg(F.sum(F.octet_length(F.array_join("lines", "")) + 8 * F.size("lines"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(found), same, "left")
    spread = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, same & (F.col("salt") == F.col("copy")), "left")


def drop_boilerplate(pages: DataFrame, site: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_col: str | None = None) -> DataFrame:
    """Pages with boilerplate lines taken out of ``text_col``; ``count_col`` gets the number of lines dropped."""
    found = materialize(boilerplate(pages, site, text_col, ratio, min_pages).withColumnRenamed("site", "its"), "boilerplate")
    joined = _joined(pages.select(site.alias("site"), F.struct(*pages.columns).alias("page")), found)
    text = F.col("page").getField(text_col)
    parts = F.split(text, "\n", -1)
    gone = F.array_intersect(F.transform(parts, _key), "lines")  # by hashing: a page meets few of its site's lines
    cut = joined.select("page", text.alias("text"), parts.alias("parts"), gone.alias("gone"))
    kept = F.filter("parts", lambda line: ~F.array_contains("gone", _key(line)))
    none = F.col("gone").isNull() | (F.size("gone") == 0)
    columns = {c: F.col("page").getField(c) for c in pages.columns}
    columns[text_col] = F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n"))
    if count_col:
        columns[count_col] = F.when(none, 0).otherwise(F.size("parts") - F.size(kept))
    return cut.select(F.struct(*(value.alias(name) for name, value in columns.items())).alias("row")).select("row.*")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, which stands for their site as they have no URL: what stays of each, by digest, and how many lines went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return _told(drop_boilerplate(docs, F.col("source"), count_col="lines_dropped"), "doc_id")


def op4_line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host: what stays of the text read from each, by digest, and how many lines went."""
    pages = extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text")
    pages = materialize(pages, "page-texts")  # read twice, to count and to cut
    return _told(drop_boilerplate(pages, host_of(F.col("url")), count_col="lines_dropped"), "page_id")


def _told(cleaned: DataFrame, id_col: str) -> DataFrame:
    return cleaned.select(
        id_col,
        F.col("lines_dropped").cast("long").alias("lines_dropped"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


OP4_SQL = r"""
WITH p AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p WHERE text IS NOT NULL),
k AS (SELECT r, source, line, pos, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS key FROM l),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
b AS (
  SELECT k.source, k.key FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE k.key <> ''
  GROUP BY k.source, k.key, t.pages
  HAVING count(DISTINCT r) >= 2 AND count(DISTINCT r) > 0.1::DOUBLE * t.pages),
j AS (SELECT k.r, k.line, k.pos, b.key IS NOT NULL AS gone FROM k LEFT JOIN b ON k.key = b.key AND k.source IS NOT DISTINCT FROM b.source),
s AS (
  SELECT r, count(*) FILTER (WHERE gone) AS lines_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM j GROUP BY r)
SELECT p.doc_id, coalesce(s.lines_dropped, 0) AS lines_dropped, length(coalesce(s.text, '')) AS chars_kept,
       sha256(coalesce(s.text, '')) AS text_sha256
FROM p LEFT JOIN s ON p.r = s.r
"""
