"""From pages, texts and pairs to indexed chunks: extraction, crawl, quota, index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.html import read_html
from quillspark.functions.text import normalize_arabic, tidy, truncate
from quillspark.functions.url import is_asset, robots_allow, robots_rules, same_site, url_key
from quillspark.functions.vector import hash_embedder
from quillspark.operators.chunking import chunk_documents
from quillspark.sources.shared import materialize

# Characters of a page worth indexing, and failures told.
THIN, TOLD = 120, 5
#: Rounds of a crawl whose pages are written together.
FOLDED = 8


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds ``title`` (the URL, where a page has none), ``text`` and ``links`` (absolute, unique, in order)."""
    read = pages.withColumn("__h", read_html(html_col, url_col))
    named = F.when(F.col("__h.title") == "", F.col(url_col)).otherwise(F.col("__h.title"))
    return read.withColumns({"title": named, "text": tidy(F.col("__h.raw")), "links": F.col("__h.links")}).drop("__h")


def page_links(pages: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """``(id_col, src, dst, place)`` for every link, ``place`` being where it first stands on its page."""
    each = pages.select(id_col, F.col(url_col).alias("src"), F.posexplode("links").alias("place", "dst"))
    return each.groupBy(id_col, "src", "dst").agg(F.min("place").alias("place"))


def is_thin(text) -> object:
    return F.length(text) < THIN


def crawl(links: DataFrame, roots: DataFrame, robots: DataFrame | None = None, user_agent: str = "quillspark", max_pages: int = 200, indexable: DataFrame | None = None) -> DataFrame:
    """Pages that a breadth-first crawl of each site fetches over known links: ``site, url, depth, turn``.

    ``links(src, dst, place)``, ``roots(site, url)``, ``robots(site, body)``.  Links stay
    on the site, are no assets, and obey robots; a site whose root they forbid is
    not crawled.  Pages are fetched first in, first out: a page's turn follows from the
    turn of the page it was first found on and the place of the link there, so the caps
    cut exactly where a queue would.  A site stops with ``max_pages`` pages of
    ``indexable(url)`` (all pages, where none is given) and discovers four times as
    many of any kind.

    A round is one depth of all sites: a join and an anti-join.  Rounds write what they
    found, and every ``FOLDED`` rounds the pages so far are written together.
    """
    spark = links.sparkSession
    path = lambda url: F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    edges = links.where(same_site(F.col("src"), F.col("dst")) & ~is_asset(path(F.col("dst"))))
    edges = edges.select(url_key(F.col("src")).alias("src_key"), "dst", url_key(F.col("dst")).alias("key"), "place")
    if robots is not None:
        ruled = roots.join(robots, "site", "left").withColumn("rules", robots_rules(F.col("body"), user_agent)["rules"])
        by_host = ruled.select(F.regexp_extract(url_key(F.col("url")), "^[^/]*", 0).alias("host"), "rules")
        edges = edges.withColumn("host", F.regexp_extract("key", "^[^/]*", 0)).join(by_host, "host", "left")
        edges = edges.where(robots_allow(F.col("rules"), path(F.col("dst")))).drop("host", "rules")
        roots = ruled.where(robots_allow(F.col("rules"), path(F.col("url"))))
    first = F.min(F.struct("place", "dst"))
    edges = materialize(edges.groupBy("src_key", "key").agg(first.alias("at")).select("src_key", "key", "at.place", "at.dst"), "crawl-edges")
    good = None if indexable is None else materialize(indexable.select(url_key(F.col("url")).alias("key"), F.lit(1).alias("good")).distinct(), "crawl-indexable")
    rated = lambda found: found.withColumn("good", F.lit(1)) if good is None else found.join(good, "key", "left").withColumn("good", F.coalesce("good", F.lit(0)))
    columns = ["site", "url", "key", "depth", "turn", "good"]
    fresh = roots.select("site", "url", url_key(F.col("url")).alias("key"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("turn"))
    rounds = [materialize(rated(fresh).select(columns), "crawl")]
    depth, seen = 0, rounds[0]
    while rounds[-1].take(1):
        depth += 1
        reached = rounds[-1].select("site", F.col("key").alias("src_key"), "turn").join(edges, "src_key")
        found = reached.groupBy("site", "key").agg(F.min(F.struct("turn", "place", F.col("dst").alias("url"))).alias("by"))
        found = rated(found.join(seen, ["site", "key"], "left_anti").select("site", "by.*", "key"))
        had = seen.groupBy("site").agg(F.count("*").alias("pages"), F.sum("good").alias("goods"))
        order = Window.partitionBy("site").orderBy("turn", "place", "key")
        before = F.coalesce(F.sum("good").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = found.join(had, "site").select("site", "url", "key", F.lit(depth).alias("depth"), (F.col("pages") + F.row_number().over(order)).alias("turn"), "good", (F.col("goods") + before).alias("goods"))
        rounds.append(materialize(ranked.where((F.col("turn") <= 4 * max_pages) & (F.col("goods") < max_pages)).select(columns), "crawl"))
        if len(rounds) > FOLDED:
            rounds = [materialize(reduce(DataFrame.unionByName, rounds[:-1]), "crawl"), rounds[-1]]
        seen = reduce(DataFrame.unionByName, rounds)
    return seen.select("site", "url", "depth", "turn")


def admission(new: DataFrame, existing: DataFrame, limits: DataFrame, order_col: str = "seq") -> DataFrame:
    """Whether the chunks of each source still fit its workspace, before anything is embedded.

    ``new(workspace, source, seq, chunks)``, ``existing(workspace, chunks)``,
    ``limits(workspace, chunk_limit)``; a limit of zero or less is none.  A refused
    source takes no room from later ones, so the running total is folded in order:
    a workspace is walked by one task, a batch at a time.  Returns ``workspace,
    source, chunks, chunk_limit, held, status``; ``held`` is what the workspace had
    when the source's turn came.
    """
    sized = new.join(existing.groupBy("workspace").agg(F.sum("chunks").alias("have")), "workspace", "left").join(limits, "workspace", "left")
    queue = sized.select(
        "workspace", F.col("source").cast("string").alias("source"), F.col("chunks").cast("long").alias("chunks"), F.coalesce("chunk_limit", F.lit(0)).cast("long").alias("chunk_limit"),
        F.coalesce("have", F.lit(0)).cast("long").alias("have"), F.col(order_col).alias("turn"),
    )
    kind = f"workspace {queue.schema['workspace'].dataType.simpleString()}, source string, chunks bigint, chunk_limit bigint, held bigint, status string"
    return queue.repartition("workspace").sortWithinPartitions("workspace", "turn", "source").mapInArrow(_admitted, kind)


def _admitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the sources of workspaces in order; a batch at a time, so a large workspace never stands in memory."""
    now, used = (), 0
    for batch in batches:
        held, status = [], []
        for workspace, chunks, have, limit in zip(*(batch.column(c).to_pylist() for c in ("workspace", "chunks", "have", "chunk_limit")), strict=True):
            if now != (workspace,):
                now, used = (workspace,), have
            fits = limit <= 0 or used + chunks <= limit
            held.append(used)
            used += chunks if fits else 0
            status.append("ready" if fits else "failed")
        columns = [batch.column(c) for c in ("workspace", "source", "chunks", "chunk_limit")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.int64()), pa.array(status, pa.string())], ["workspace", "source", "chunks", "chunk_limit", "held", "status"])


def within_quota(new: DataFrame, existing: DataFrame, limits: DataFrame, order_col: str = "seq") -> DataFrame:
    """``(workspace, source, chunks, status)`` of every source, as ``admission`` judges it."""
    return admission(new, existing, limits, order_col).select("workspace", "source", "chunks", "status")


def index_documents(docs: DataFrame, id_col: str, text_col: str, dims: int = 1024) -> DataFrame:
    """Chunks with position, normal form and embedding."""
    chunks = chunk_documents(docs, id_col, text_col)
    return chunks.withColumns({"text_normalized": normalize_arabic(F.col("text")), "embedding": hash_embedder(dims)(normalize_arabic(F.lower("text")))})


def skipped_summary(skipped: DataFrame, key: str, order_col: str) -> DataFrame:
    """Per source: how many pages were left out, the first five with their reasons, and how many more.

    Pages are ranked first, so no more than five of a source are ever collected.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order_col, "url", "reason"))
    first = skipped.withColumn("__rank", rank).where(F.col("__rank") <= TOLD)
    told = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__rank", F.concat("url", F.lit(" ("), "reason", F.lit(")")).alias("text")))).alias("told"))
    n, counts = F.col("n"), skipped.groupBy(key).agg(F.count("*").alias("n"))
    listed = F.array_join(F.col("told.text"), "; ")
    text = F.concat(n.cast("string"), F.lit(" page(s) were not indexed: "), listed, F.when(n > TOLD, F.concat(F.lit("and "), (n - TOLD).cast("string"), F.lit(" more"))).otherwise(""))
    return counts.join(told, key).select(key, truncate(text, 2000).alias("summary"))
