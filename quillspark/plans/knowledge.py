"""Queries over the stored knowledge base: what its tables hold after ingest, answers, deletion and refresh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import ingest, knowledge
from quillspark.operators.retrieval import knn_batch
from quillspark.plans.views import table, view, with_views
from quillspark.sources.commits import Store
from quillspark.sources.shared import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2024-06-01T00:00:00Z"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def _store(s) -> Store:
    return knowledge.open_store(s, scratch_path(s, "knowledge"))


def _loaded(s, name: str, rows: DataFrame) -> DataFrame:
    """Rows with every column of a stored table, null where they have none."""
    schema = s.createDataFrame([], knowledge.TABLES[name]).schema
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


#: A chunk for every question of a conversation with the turn after it; those blank on both sides are none.
PAIRS = """
p AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user'),
n AS (SELECT conv_id, count(*) FILTER (WHERE regexp_replace(coalesce(question, '') || coalesce(answer, ''), '\\s', '', 'g') <> '') AS chunks FROM p GROUP BY conv_id)
"""
#: Chunks that a workspace of the test may have.
LIMIT = 60


def _faq_requests(s, d) -> DataFrame:
    turns = table(s, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = turns.where("role = 'user'").join(after, ["conv_id", "turn"], "left")
    each = pairs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("question"), "answer"))).alias("pairs"))
    return each.select(
        F.concat(F.lit("faq-"), F.col("conv_id").cast("string")).alias("source"), (F.col("conv_id") % 8).cast("string").alias("workspace"), F.lit("faq").alias("type"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.lit("").alias("body"),
        F.transform("pairs", lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer"))).alias("pairs"), F.col("conv_id").alias("seq"),
    )


@query(f"""WITH RECURSIVE {PAIRS},
q AS (SELECT conv_id, conv_id % 8 AS workspace, chunks, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id) AS place FROM n WHERE chunks > 0),
r AS (SELECT DISTINCT workspace, 0::BIGINT AS place, 0::BIGINT AS held, 0::BIGINT AS used, NULL::BIGINT AS conv_id, NULL::BIGINT AS chunks FROM q
  UNION ALL SELECT q.workspace, q.place, r.used, CASE WHEN r.used + q.chunks <= {LIMIT} THEN r.used + q.chunks ELSE r.used END, q.conv_id, q.chunks FROM r JOIN q ON q.workspace = r.workspace AND q.place = r.place + 1)
SELECT 'faq-' || conv_id AS source, CAST(workspace AS VARCHAR) AS workspace, CASE WHEN used > held THEN 'ready' ELSE 'failed' END AS status,
  CASE WHEN used > held THEN '' ELSE 'workspace chunk limit reached: ' || chunks || ' chunks would exceed the plan limit of {LIMIT} (currently ' || held || ')' END AS error,
  CASE WHEN used > held THEN chunks ELSE 0 END AS pages, CASE WHEN used > held THEN chunks ELSE 0 END AS chunks FROM r WHERE place > 0""")
def ingest_faq(s, d):
    """Conversations taken in as question-answer sources: their state, and the chunks they have with vectors."""
    store = _store(s)
    requests = _faq_requests(s, d)
    limits = requests.select("workspace").distinct().withColumn("chunk_limit", F.lit(LIMIT))
    knowledge.ingest(store, requests, limits, NOW)
    have = store.read("chunks").where("size(embedding) = 1024").groupBy("source").agg(F.count("*").alias("chunks"))
    return store.read("sources").join(have, "source", "left").select("source", "workspace", "status", "error", "pages", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


@query()
def ingest_texts(s, d):
    """Documents taken in as texts: their chunks as stored."""
    store = _store(s)
    docs = table(s, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), F.col("source").alias("workspace"), F.lit("text").alias("type"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("body"), F.lit(None).cast("array<struct<question:string,answer:string>>").alias("pairs"), F.col("doc_id").alias("seq"))
    knowledge.ingest(store, docs, docs.select("workspace").distinct().withColumn("chunk_limit", F.lit(0)), NOW)
    return store.read("chunks").select("chunk", "source", "position", "text", "text_normalized", "embedding")


def _site_pages(s, d) -> tuple[DataFrame, DataFrame]:
    """Pages by host, in order of their id: those worth indexing, and those left out with the reason."""
    pages = ingest.extract_pages(table(s, d, "pages")).withColumn("source", F.concat(F.lit("site-"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)))
    pages = pages.select("source", F.col("page_id").alias("place"), "url", "title", "text")
    thin = ingest.is_thin(F.col("text"))
    return pages.where(~thin), pages.where(thin).select("source", "place", "url", F.lit("not enough text to index").alias("reason"))


@query()
def refresh_sites(s, d):
    """Sites taken in, then refreshed: the second time replaces the first."""
    store = _store(s)
    docs, skipped = _site_pages(s, d)
    sites = docs.select("source").unionByName(skipped.select("source")).distinct()
    knowledge.add_websites(store, sites.select("source", F.lit("w").alias("workspace"), F.col("source").alias("title"), F.concat(F.lit("https://"), F.substring("source", 6, 1000)).alias("url")), NOW)
    targets = sites.withColumn("seq", F.col("source"))
    limits = s.range(1).select(F.lit("w").alias("workspace"), F.lit(0).alias("chunk_limit"))
    for _ in range(2):
        knowledge.refresh(store, targets, docs, skipped, limits, NOW)
    have = store.read("chunks").groupBy("source").agg(F.count("*").alias("chunks"), F.max("position").alias("last_position"))
    return store.read("sources").join(have, "source", "left").select("source", "status", "error", "pages", "chunks", "last_position")


def _filled(s, d) -> Store:
    """Every table of the store, from the test tables."""
    text = lambda c: F.col(c).cast("string").alias(c)
    suppliers = table(s, d, "supplier")
    conversations, messages, leads, gaps = (view(s, d, n) for n in ("conversations", "messages", "leads", "questions"))
    rows = {
        "accounts": view(s, d, "accounts").select(text("account"), F.col("account_name").alias("name")),
        "workspaces": view(s, d, "workspaces").select(text("workspace"), text("account"), "name"),
        "memberships": view(s, d, "memberships").select(text("workspace"), text("user"), "role"),
        "sources": suppliers.select(F.col("s_suppkey").cast("string").alias("source"), F.col("s_nationkey").cast("string").alias("workspace"), F.lit("text").alias("type"), F.lit("ready").alias("status")),
        "chunks": view(s, d, "vectors").select(text("chunk_id").alias("chunk"), text("workspace_id").alias("workspace"), (F.col("chunk_id") % 50 + 1).cast("string").alias("source"), "embedding"),
        "conversations": conversations.select(text("conversation"), text("workspace"), "status"),
        "messages": messages.select(F.concat_ws("-", "conversation", "turn").alias("message"), text("workspace"), text("conversation"), "role", "text"),
        "leads": leads.select(text("lead"), text("workspace"), text("conversation")),
        "escalations": leads.groupBy(text("conversation"), text("workspace")).agg(F.max("lead").cast("string").alias("lead")),
        "knowledge_gaps": gaps.groupBy(text("workspace"), F.col("question").alias("question_normalized")).agg(F.count("*").alias("count"), F.first("question").alias("question"), F.lit(False).alias("answered")),
    }
    store = _store(s)
    store.commit({name: _loaded(s, name, df) for name, df in rows.items()})
    return store


LEFT = {
    "accounts": "v_accounts", "workspaces": "v_workspaces WHERE workspace <> 3", "memberships": "v_memberships WHERE workspace <> 3",
    "sources": "supplier WHERE s_nationkey <> 3", "chunks": "v_vectors WHERE workspace_id <> 3 AND (chunk_id % 50 + 1) NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)",
    "conversations": "v_conversations WHERE workspace <> 3", "messages": "v_messages WHERE workspace <> 3", "leads": "v_leads WHERE workspace <> 3",
    "escalations": "(SELECT DISTINCT conversation FROM v_leads WHERE workspace <> 3)", "knowledge_gaps": "(SELECT DISTINCT workspace, question FROM v_questions WHERE workspace <> 3)",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {rest}" for name, rest in LEFT.items()))
def workspace_deleted(s, d):
    """Rows of every table after one workspace went, with all that refers to it."""
    store = _filled(s, d)
    knowledge.delete_records(store, "workspaces", s.range(1).select(F.lit("3").alias("workspace")))
    return reduce(DataFrame.unionByName, [store.read(name).select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n")) for name in LEFT])


@query("""WITH c AS (SELECT * FROM v_vectors WHERE chunk_id % 50 + 1 > 10),
p AS (SELECT q.workspace_id, q.chunk_id AS query_id, c.chunk_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance FROM v_vectors q JOIN c ON q.workspace_id = c.workspace_id WHERE q.chunk_id % 20 = 0)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(chunk_id AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, CAST(chunk_id AS VARCHAR)) AS rank FROM p QUALIFY rank <= 10""")
def search_after_deletion(s, d):
    """Nearest chunks of one chunk in twenty, after ten sources went and the chunks were written anew."""
    store = _filled(s, d)
    asked = store.read("chunks").where("CAST(chunk AS BIGINT) % 20 = 0").select(F.col("workspace").alias("workspace_id"), F.col("chunk").alias("query_id"), F.col("embedding").alias("query"))
    knowledge.delete_records(store, "sources", s.range(1, 11).select(F.col("id").cast("string").alias("source")))
    store.compact("chunks")
    vectors = store.read("chunks").select(F.col("workspace").alias("workspace_id"), F.col("chunk").alias("chunk_id"), "embedding")
    return knn_batch(vectors, asked).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH g AS (SELECT workspace, question, count(*) AS n FROM v_questions GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY question) AS place FROM g WHERE n % 2 = 1 AND trim(question) <> '')
SELECT CAST(g.workspace AS VARCHAR) AS workspace, g.question, coalesce(k.place <= 5, false) AS answered FROM g LEFT JOIN k ON g.workspace = k.workspace AND g.question = k.question""")
def gaps_answered(s, d):
    """Gaps after answers to those asked an odd number of times, while five chunks fit each workspace."""
    store = _store(s)
    gaps = view(s, d, "questions").groupBy(F.col("workspace").cast("string").alias("workspace"), "question").agg(F.count("*").alias("count"))
    store.commit({"knowledge_gaps": _loaded(s, "knowledge_gaps", gaps.withColumns({"question_normalized": F.col("question"), "answered": F.lit(False)}))})
    answers = gaps.where("count % 2 = 1 and trim(question) <> ''").select("workspace", F.col("question").alias("question_normalized"), F.lit("The answer.").alias("answer"), F.col("question").alias("seq"))
    knowledge.answer_gaps(store, answers, gaps.select("workspace").distinct().withColumn("chunk_limit", F.lit(5)), NOW)
    return store.read("knowledge_gaps").select("workspace", "question", "answered")


@query("SELECT 'accounts' AS name, CAST(count(DISTINCT usr) AS BIGINT) AS n, CAST(count(DISTINCT usr) AS BIGINT) AS met FROM v_users UNION ALL SELECT 'memberships', count(DISTINCT usr), count(DISTINCT usr) FROM v_users UNION ALL SELECT 'workspaces', count(DISTINCT usr), count(DISTINCT usr) FROM v_users")
def signed_up(s, d):
    """What sign-ups leave in three tables, and how many of the rows meet those they refer to."""
    store = _store(s)
    knowledge.sign_up(store, view(s, d, "users"), NOW)
    accounts, workspaces, memberships = (store.read(n) for n in ("accounts", "workspaces", "memberships"))
    met = {"accounts": accounts.join(workspaces, "account"), "workspaces": workspaces.join(accounts.select("account"), "account"), "memberships": memberships.join(workspaces, "workspace")}
    count = lambda df, name: df.groupBy().agg(F.count("*").alias(name))
    parts = [count(df, "n").join(count(met[name], "met")).select(F.lit(name).alias("name"), "n", "met") for name, df in (("accounts", accounts), ("workspaces", workspaces), ("memberships", memberships))]  # one row each
    return reduce(DataFrame.unionByName, parts)
