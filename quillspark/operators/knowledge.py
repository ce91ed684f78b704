"""The knowledge base as stored tables: ingest, refresh, answers, sign-up, cascading deletion, search.

All tables live in one ``Store``.  A source, its chunks and their vectors (a column of
the chunk) are published by one commit, so they appear together or not at all.

Ingest: requests without usable content are refused before there is a source; the
others become sources ``processing``, pass the quota of their workspace in order before
anything is embedded, and end ``ready`` or ``failed`` with the reason.  If the job itself
fails, its sources are marked ``failed`` and the error is passed on.

Refresh: the old chunks go first, so a refresh that fails leaves the source empty and
visibly so, never stale.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import empty_crawl, normalize_arabic, short_reason, truncate
from quillspark.functions.vector import hash_embedder
from quillspark.operators.chunking import chunk_documents, chunk_pairs, titled_chunks
from quillspark.operators.ingest import admission, skipped_summary
from quillspark.operators.retrieval import knn
from quillspark.operators.tenancy import provision
from quillspark.sources.commits import Store
from quillspark.sources.schemas import TABLES, checked
from quillspark.sources.shared import materialize

Embedder = Callable[[Column], Column]

#: Child, its column, and the parent and key that it refers to: what goes when the parent goes.
REFERENCES = [
    ("workspaces", "account", "accounts", "account"), ("usage", "account", "accounts", "account"),
    ("memberships", "workspace", "workspaces", "workspace"), ("invitations", "workspace", "workspaces", "workspace"), ("sources", "workspace", "workspaces", "workspace"),
    ("chunks", "workspace", "workspaces", "workspace"), ("conversations", "workspace", "workspaces", "workspace"), ("messages", "workspace", "workspaces", "workspace"),
    ("leads", "workspace", "workspaces", "workspace"), ("escalations", "workspace", "workspaces", "workspace"), ("knowledge_gaps", "workspace", "workspaces", "workspace"),
    ("chunks", "source", "sources", "source"), ("messages", "conversation", "conversations", "conversation"), ("leads", "conversation", "conversations", "conversation"),
    ("escalations", "conversation", "conversations", "conversation"), ("escalations", "lead", "leads", "lead"),
]


def open_store(spark: SparkSession, base: str) -> Store:
    """The store in a folder; chunks are cut by workspace, so a search reads one tenant's files."""
    return Store(spark, base, TABLES, {"chunks": ["workspace"]}, checked)


def _sources(rows: DataFrame, now: str, **columns: Column) -> DataFrame:
    """Source rows; ``pages`` and ``last_refreshed`` are only set by what made them ready."""
    given = {"url": F.lit(""), "error": F.lit(""), "pages": F.lit(0).cast("long"), "last_refreshed": F.lit(None).cast("timestamp")} | columns
    stamp = F.lit(now).cast("timestamp")
    names = [c for c in TABLES["sources"].replace(",", "").split()[::2]]
    extra = {c: x for c, x in ({"created": stamp, "updated": stamp} | given).items() if c in columns or c not in rows.columns}
    return rows.withColumns(extra).select(*names)


def _publish_chunks(store: Store, work: DataFrame, chunks: DataFrame, limits: DataFrame, message: Column, embed: Embedder, now: str, done: Column) -> None:
    """Quota, embeddings, then chunks and the final state of their sources, in one commit.

    ``work`` are source rows with ``seq``; ``chunks(source, position, text)``.
    """
    try:
        counts = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
        new = work.join(counts, "source").select("workspace", "source", "seq", "chunks")
        have = store.read("chunks").groupBy("workspace").agg(F.count("*").alias("chunks"))
        judged = materialize(admission(new, have, limits), "admission")
        ready = judged.where("status = 'ready'").select("source", "workspace")
        made = chunks.join(ready, "source").withColumns({
            "chunk": F.concat_ws("-", "source", "position"), "position": F.col("position").cast("long"),
            "text_normalized": normalize_arabic(F.col("text")), "embedding": embed(F.col("text")), "created": F.lit(now).cast("timestamp"),
        })
        refused = F.col("verdict") == "failed"
        both = work.drop("status", "error", "pages", "last_refreshed", "updated").join(judged.select("source", F.col("status").alias("verdict"), "chunks", "held", "chunk_limit"), "source")
        final = both.withColumns({
            "status": F.col("verdict"), "error": F.when(refused, short_reason(message)).otherwise(done),
            "pages": F.when(refused, F.lit(0).cast("long")).otherwise(F.coalesce(F.col("docs"), F.col("chunks"))),
            "last_refreshed": F.when(~refused, F.lit(now).cast("timestamp")), "updated": F.lit(now).cast("timestamp"),
        })
        final = materialize(final.select(*store.read("sources").columns), "sources-done")
        rows, gone = store.replace("sources", ["source"], final)
        store.commit(rows | {"chunks": made.select(*store.read("chunks").columns)}, gone)
    except Exception as error:
        _fail(store, work.select("source"), F.lit(f"could not build the search index: {type(error).__name__}"), now)
        raise


def _fail(store: Store, sources: DataFrame, reason: Column, now: str) -> None:
    """Mark sources as failed, as they stand now."""
    rows = store.read("sources").join(sources, "source", "left_semi" if len(sources.columns) == 1 else "inner")
    failed = rows.withColumns({"status": F.lit("failed"), "error": truncate(reason, 2000), "updated": F.lit(now).cast("timestamp")})
    store.commit(*store.replace("sources", ["source"], failed.select(*store.read("sources").columns)))


def ingest(store: Store, requests: DataFrame, limits: DataFrame, now: str, embed: Embedder | None = None) -> DataFrame:
    """Take in texts and question-answer pairs; returns ``(source, error)`` of requests that were refused.

    ``requests(source, workspace, type, title, body, pairs, seq)``, each source id new,
    ``limits(workspace, chunk_limit)``.  Blank workspaces are refused, and so are kinds
    other than ``text`` and ``faq``.
    """
    requests = materialize(requests, "requests")
    texts = chunk_documents(requests.where("type = 'text'"), "source", "body")
    pairs = chunk_pairs(requests.where("type = 'faq'"), "source", "pairs")
    chunks = materialize(texts.select("source", "position", "text").unionByName(pairs.select("source", "position", "text")), "request-chunks")
    filled = chunks.select("source").distinct().withColumn("filled", F.lit(True))
    # What a refused request is told.
    reason = (
        F.when(F.coalesce("workspace", F.lit("")) == "", "workspace is required")
        .when(F.coalesce("type", F.lit("")).isin("website", "pdf"), F.concat(F.lit('source type "'), "type", F.lit('" is not implemented yet')))
        .when(~F.coalesce("type", F.lit("")).isin("text", "faq"), F.concat(F.lit('unknown source type "'), F.coalesce("type", F.lit("")), F.lit('"')))
        .when(F.col("filled").isNull(), "source has no usable content")
    )
    told = materialize(requests.join(filled, "source", "left").withColumn("reason", reason), "requests-judged")
    taken = told.where("reason is null")
    work = _sources(taken.select("source", "workspace", "type", "title"), now, status=F.lit("processing"))
    store.commit({"sources": work})
    work = materialize(work.join(taken.select("source", "seq"), "source").withColumn("docs", F.lit(None).cast("long")), "work")
    count = lambda c: F.col(c).cast("string")
    # Fixed value: the sentence that tells of a full plan.
    full = F.concat(F.lit("ingest: workspace chunk limit reached: "), count("chunks"), F.lit(" chunks would exceed the plan limit of "), count("chunk_limit"), F.lit(" (currently "), count("held"), F.lit(")"))
    _publish_chunks(store, work, chunks.join(taken.select("source"), "source", "left_semi"), limits, full, embed or hash_embedder(), now, F.lit(""))
    return told.where("reason is not null").select("source", F.col("reason").alias("error"))


def add_websites(store: Store, requests: DataFrame, now: str) -> None:
    """Queue website sources ``(source, workspace, title, url)``; ``refresh`` takes in their pages."""
    store.commit({"sources": _sources(requests.withColumn("type", F.lit("website")), now, status=F.lit("queued"))})


def refresh(store: Store, targets: DataFrame, docs: DataFrame, skipped: DataFrame, limits: DataFrame, now: str, embed: Embedder | None = None) -> DataFrame:
    """Index what a crawl of website sources found anew; returns ``(source, error)`` of targets that can't be refreshed.

    ``targets(source, seq)``, ``docs(source, place, url, title, text)`` in the order of the
    crawl, ``skipped(source, place, url, reason)``.  Every page is chunked alone, under its
    title; positions run on across pages.
    """
    sources = store.read("sources")
    known = targets.join(sources, "source", "left")
    # What is told of a source that can't be refreshed.
    reason = (
        F.when(F.col("workspace").isNull(), "source not found")
        .when(F.col("type") != "website", "only website sources can be refreshed")
        .when(F.coalesce("url", F.lit("")) == "", "source has no URL")
    )
    known = materialize(known.withColumn("reason", reason), "targets")
    taken = known.where("reason is null").drop("reason")
    queued = taken.withColumns({"status": F.lit("queued"), "error": F.lit(""), "pages": F.lit(0).cast("long"), "updated": F.lit(now).cast("timestamp")})
    rows, gone = store.replace("sources", ["source"], queued.drop("seq"))
    store.commit(rows, gone | {"chunks": [taken.select("source")]})

    own = docs.join(taken.select("source"), "source", "left_semi").withColumn("page", F.concat_ws("-", "source", "place"))
    plain = chunk_documents(own, "page", "text").join(own.select("page", "source", "place", "title"), "page")
    chunks = materialize(titled_chunks(plain, "source", "place", "title").select("source", "position", "text"), "site-chunks")
    pages = own.groupBy("source").agg(F.count("*").alias("docs"))
    summary = skipped_summary(skipped, "source", "place").withColumnRenamed("summary", "left_out")
    state = taken.join(pages, "source", "left").join(summary, "source", "left").join(chunks.select("source").distinct().withColumn("filled", F.lit(True)), "source", "left")
    state = materialize(state.withColumn("left_out", F.coalesce("left_out", F.lit(""))), "crawled")
    # Why a crawl gave nothing.
    empty = F.when(F.col("docs").isNull(), empty_crawl(F.length("left_out"), F.col("left_out"))).otherwise("the pages we could read contained no usable text")
    none = state.where("filled is null").select("source", empty.alias("why"))
    if none.take(1):
        _fail(store, none, F.col("why"), now)
    count = lambda c: F.col(c).cast("string")
    full = F.concat(F.lit("ingest: workspace chunk limit reached: this site produced "), count("chunks"), F.lit(" passages, which would exceed the plan limit of "), count("chunk_limit"))
    _publish_chunks(store, state.where("filled"), chunks, limits, full, embed or hash_embedder(), now, F.col("left_out"))
    return known.where("reason is not null").select("source", F.col("reason").alias("error"))


def answer_gaps(store: Store, answers: DataFrame, limits: DataFrame, now: str, embed: Embedder | None = None) -> DataFrame:
    """Answers ``(workspace, question_normalized, answer, seq)`` to gaps become question-answer sources.

    A gap counts as answered only once its source is ready.  Returns what was refused.
    """
    keys = ["workspace", "question_normalized"]
    asked = store.read("knowledge_gaps").join(answers.where("trim(coalesce(answer, '')) <> ''"), keys)
    asked = materialize(asked.withColumn("source", F.concat(F.lit("gap-"), F.sha2(F.concat_ws("\n", *keys), 256))), "answers")
    requests = asked.select("source", "workspace", F.lit("faq").alias("type"), F.col("question").alias("title"), F.lit("").alias("body"), F.array(F.struct("question", "answer")).alias("pairs"), "seq")
    refused = ingest(store, requests, limits, now, embed)
    ready = store.read("sources").where("status = 'ready'").select("source")
    done = asked.join(ready, "source", "left_semi").drop("source", "answer", "seq").withColumns({"answered": F.lit(True), "updated": F.lit(now).cast("timestamp")})
    store.commit(*store.replace("knowledge_gaps", keys, materialize(done, "gaps-answered")))
    return refused


def sign_up(store: Store, users: DataFrame, now: str) -> None:
    """Account, workspace and ownership of new users, published together."""
    stamp, text = F.lit(now).cast("timestamp"), F.lit("")
    made = provision(users)
    store.commit({
        "accounts": made["accounts"].select("account", F.col("account_name").alias("name"), "kind", "plan", F.lit(0.0).alias("hard_cap_usd"), *(text.alias(c) for c in ("stripe_customer_id", "stripe_subscription_id", "subscription_status", "stripe_price_id")), F.lit(None).cast("timestamp").alias("current_period_end"), F.lit(False).alias("cancel_at_period_end"), stamp.alias("created"), stamp.alias("updated")),
        "workspaces": made["workspaces"].select("workspace", "name", "account", *(text.alias(c) for c in ("widget_key", "widget_config", "allowed_domains")), F.lit(0).cast("long").alias("retention_days"), stamp.alias("created"), stamp.alias("updated")),
        "memberships": made["memberships"].select("workspace", F.col("user").cast("string").alias("user"), "role", stamp.alias("created")),
    })


def cascade(store: Store, table: str, keys: DataFrame) -> dict[str, list[DataFrame]]:
    """What goes with the records of ``table`` whose key is in ``keys`` (one column), by references, parents first."""
    gone: dict[str, list[DataFrame]] = {table: [keys]}
    reached = [(table, keys)]
    while reached:
        parent, known = reached.pop(0)
        for child, column, of, key in REFERENCES:
            if of != parent or key not in known.columns:
                continue
            goes = known.select(F.col(key).alias(column)).distinct()
            gone.setdefault(child, []).append(goes)
            own = next((k for _, _, p, k in REFERENCES if p == child), None)
            if own and own != column:
                reached.append((child, materialize(store.read(child).join(goes, column, "left_semi").select(own), "cascade")))
    return gone


def delete_records(store: Store, table: str, keys: DataFrame) -> int:
    """Delete records and all that refers to them, in one commit.

    Workspaces are refused if that leaves an account without any.
    """
    version, keys = store.version(), materialize(keys, "doomed")
    if table == "workspaces":
        owned = store.read("workspaces")
        left = owned.join(keys, "workspace", "left_anti").select("account")
        if owned.join(keys, "workspace", "left_semi").join(left, "account", "left_anti").take(1):
            raise ValueError("an account keeps at least one workspace")
    return store.commit(gone=cascade(store, table, keys), expect=version)


def search(store: Store, workspace: str, query: list[float], k: int = 8) -> DataFrame:
    """The nearest chunks of one tenant: ``chunk_id, distance``."""
    vectors = store.read("chunks").select(F.col("workspace").alias("workspace_id"), F.col("chunk").alias("chunk_id"), "embedding")
    return knn(vectors, workspace, query, k)


def orphans(store: Store) -> dict[str, DataFrame]:
    """Rows of every table that refer to a record that isn't there; unset references are none."""
    found: dict[str, list[DataFrame]] = {}
    for child, column, parent, key in REFERENCES:
        rows = store.read(child).where(F.coalesce(column, F.lit("")) != "")
        found.setdefault(child, []).append(rows.join(store.read(parent).select(F.col(key).alias(column)), column, "left_anti").select(F.lit(column).alias("reference"), F.col(column).alias("value")))
    return {child: reduce(DataFrame.unionByName, parts) for child, parts in found.items()}
