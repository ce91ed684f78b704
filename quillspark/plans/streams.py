"""Structured Streaming queries: the tables read as a stream, folded, and returned as they ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import knowledge
from quillspark.plans.views import VIEWS, table, view, with_views
from quillspark.sources.shared import materialize, scratch_path
from quillspark.streaming import live, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def as_stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream of new files; a single file is met through a pattern."""
    schema = table(s, d, name).schema
    return s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


def final(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over all there is, and return the last row of every key it put out.

    Each micro-batch appends its rows to a table in the shared folder with its
    number; a batch written again after a failure replaces its own folder.
    """
    s = stream.sparkSession
    path = scratch_path(s, "stream")

    def put(rows: DataFrame, number: int) -> None:
        rows.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/n={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = s.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, __batch int").option("recursiveFileLookup", "true").parquet(f"{path}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("last")) if rest else rows.select(*keys).distinct()
    return last.select(*keys, "last.*") if rest else last


def per_batch(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What ``apply`` makes of every micro-batch of a stream, one after the other; a repeated batch replaces its folder."""
    s = stream.sparkSession
    path = scratch_path(s, "batches")

    def put(rows: DataFrame, number: int) -> None:
        apply(rows).write.mode("overwrite").parquet(f"{path}/out/n={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


@query("SELECT o_custkey AS account, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS replies, round(count(*) FILTER (WHERE o_orderkey % 5 = 0) * 0.02, 6) AS overage_usd FROM orders GROUP BY 1, 2")
def stream_usage(s, d):
    rows = as_stream(s, d, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 5 == 0).alias("overage"))
    return final(live.usage_stream(rows), ["account", "period"]).withColumn("overage_usd", F.round("overage_usd", 6))


@query(r"SELECT workspace, trim(regexp_replace(question, '\s+', ' ', 'g')) AS question_normalized, count(*) AS n, max(similarity)::DOUBLE AS best_similarity, arg_min(question, seq) AS question FROM v_questions GROUP BY 1, 2")
def stream_gaps(s, d):
    turns = as_stream(s, d, "conversations")
    rows = s.sql(VIEWS["questions"], conversations=turns)
    return final(live.gap_stream(rows, "seq"), ["workspace", "question_normalized"]).select("workspace", "question_normalized", "n", F.col("best_similarity").cast("double").alias("best_similarity"), "question")


def dealt(s: SparkSession, rows: DataFrame, by: str, files: int = 3) -> DataFrame:
    """Rows as a stream of a few files, one a micro-batch, cut by a column and arriving in its order."""
    path = scratch_path(s, "arrivals")
    parts = materialize(rows.repartitionByRange(files, by).withColumn("__part", F.spark_partition_id()), "arrivals")
    for part in range(files):  # one after the other: files are met in the order they were written
        parts.where(F.col("__part") == part).drop("__part").coalesce(1).sortWithinPartitions(by).write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _kept(s: SparkSession, stream: DataFrame, table_name: str, keys: list[str], fold) -> DataFrame:
    store = knowledge.open_store(s, scratch_path(s, "kept"))
    stored.keep(stream, store, table_name, keys, fold, table_name, scratch_path(s, "kept-state")).awaitTermination()
    return store.read(table_name)


@query("SELECT event_id, arg_min(type, seq) AS type FROM v_ledger_events GROUP BY 1")
def stream_ledger(s, d):
    """The stored ledger after all deliveries, in several batches: each id as first delivered, whatever time lies between."""
    rows = view(s, d, "ledger_events").select("event_id", "type", F.lit("").alias("account"), F.lit("").alias("result"), "seq", F.col("ts").cast("timestamp").alias("at"))
    return _kept(s, dealt(s, rows, "seq"), "billing_events", ["event_id"], stored.fold_ledger).select("event_id", "type")


@query("SELECT CAST(account AS VARCHAR) AS account, strftime(ts, '%Y-%m') AS period, count(*) AS ai_replies_used, round(count(*) FILTER (WHERE overage) * 0.02, 6) AS overage_usd FROM v_replies GROUP BY 1, 2")
def stored_usage(s, d):
    """Stored counters after all replies, in several batches that meet the same accounts and months."""
    rows = view(s, d, "replies").select(F.col("account").cast("string").alias("account"), "ts", "overage", "seq")
    return _kept(s, stored.with_period(dealt(s, rows, "seq")), "usage", ["account", "period"], stored.fold_usage).withColumn("overage_usd", F.round("overage_usd", 6))


@query(r"SELECT CAST(workspace AS VARCHAR) AS workspace, trim(regexp_replace(question, '\s+', ' ', 'g')) AS question_normalized, count(*) AS n, max(similarity)::DOUBLE AS best_similarity, arg_min(question, seq) AS question, arg_min(language, seq) AS language FROM v_questions GROUP BY 1, 2")
def stored_gaps(s, d):
    """Stored gaps after all unanswered questions, in several batches."""
    rows = view(s, d, "questions").withColumns({"workspace": F.col("workspace").cast("string"), "at": F.timestamp_millis(F.col("seq"))})
    kept = _kept(s, stored.with_normal_form(dealt(s, rows, "seq")), "knowledge_gaps", ["workspace", "question_normalized"], stored.fold_gaps)
    return kept.select("workspace", "question_normalized", F.col("count").alias("n"), "best_similarity", "question", "language")


@query("SELECT CAST(conversation AS VARCHAR) AS conversation, CAST(max(lead) AS VARCHAR) AS lead, 'pending' AS status FROM v_leads GROUP BY 1")
def stored_escalations(s, d):
    """Stored escalations after all requests, in several batches."""
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = view(s, d, "leads").select(text("conversation"), text("workspace"), text("lead"), F.col("lead").alias("seq"), F.timestamp_millis("created_ms").alias("at"))
    return _kept(s, dealt(s, rows, "seq"), "escalations", ["conversation"], stored.fold_escalations).select("conversation", "lead", "status")


@query("""WITH m AS (SELECT conversation FROM v_messages WHERE role = 'human'), u AS (SELECT c_custkey AS subscriber, c_custkey % 200 AS conversation FROM customer),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY subscriber) AS n FROM u) WHERE n <= 8), k AS (SELECT subscriber, count(*) AS n FROM m JOIN a ON m.conversation = a.conversation GROUP BY 1)
SELECT subscriber, n AS events FROM k""")
def stream_fanout(s, d):
    """Events that go out to each subscriber."""
    rows = s.sql(VIEWS["messages"], conversations=as_stream(s, d, "conversations"))
    subscribers = table(s, d, "customer").select(F.col("c_custkey").alias("subscriber"), (F.col("c_custkey") % 200).alias("conversation"))
    sent = live.fan_out(live.published(rows), subscribers)
    return final(sent.groupBy("subscriber").agg(F.count("*").alias("events")), ["subscriber"])


@query("SELECT user_id AS subscriber, least(count(*), 16) AS delivered, greatest(count(*) - 16, 0) AS dropped FROM events GROUP BY 1")
def stream_buffers(s, d):
    """What buffers of sixteen, emptied after every micro-batch (here one), deliver and drop."""
    rows = as_stream(s, d, "events").select(F.col("user_id").alias("subscriber"))
    batches = per_batch(rows, live.deliver, "subscriber bigint, delivered bigint, dropped bigint")
    return batches.groupBy("subscriber").agg(F.sum("delivered").alias("delivered"), F.sum("dropped").alias("dropped"))


@query("SELECT DISTINCT event_id AS id, event_id <= 100 AS replayed FROM events")
def stream_replay(s, d):
    """A hundred events of history, then the live stream without them."""
    history = table(s, d, "events").where("event_id <= 100").select(F.col("event_id").alias("id"))
    live_rows = as_stream(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    stream = live.not_replayed(live_rows, history).select("id", F.lit(False).alias("replayed"))
    return history.withColumn("replayed", F.lit(True)).unionByName(final(stream, ["id"], "append"))


@query("SELECT conversation, status IN ('human', 'escalated') AS with_human FROM v_conversations")
def stream_status(s, d):
    """Whether a person has each conversation, from the stream of its status events."""
    rows = s.sql(VIEWS["conversations"].replace("SELECT DISTINCT", "SELECT"), conversations=as_stream(s, d, "conversations"))
    return final(live.with_human(live.status_events(rows)), ["conversation"])


@query("SELECT conversation, count(*) FILTER (WHERE kind = 'message') AS messages, count(*) FILTER (WHERE kind = 'status') AS statuses FROM (SELECT conversation, 'message' AS kind FROM v_messages WHERE role = 'human' UNION ALL SELECT conversation, 'status' FROM v_conversations) GROUP BY 1")
def stream_published(s, d):
    """What goes out live of each conversation: people's messages, and its status."""
    turns = as_stream(s, d, "conversations")
    messages = s.sql(VIEWS["messages"], conversations=turns)
    updates = s.sql(VIEWS["conversations"].replace("SELECT DISTINCT", "SELECT"), conversations=turns.where("turn = 0"))
    sent = live.events(messages, updates)
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return final(sent.groupBy("conversation").agg(n("message").alias("messages"), n("status").alias("statuses")), ["conversation"])


@query("SELECT workspace, conversation, count(*) AS n FROM v_messages WHERE role = 'human' GROUP BY 1, 2")
def published_messages(s, d):
    return live.published(view(s, d, "messages")).groupBy("workspace", "conversation").agg(F.count("*").alias("n"))


