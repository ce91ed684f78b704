"""Streams that keep tables: every micro-batch is merged by key into the store, once.

A batch reads the rows of its own keys, folds its rows in, and publishes what comes out
in one commit under the batch's tag.  A batch that is delivered again finds its tag and
changes nothing, so a restart between the commit and the stream's own checkpoint is
harmless.  The stream itself holds no state: what it has to remember is in the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import normalize_arabic
from quillspark.operators.usage import OVERAGE_USD, period
from quillspark.sources.commits import Store
from quillspark.sources.shared import materialize

Fold = Callable[[DataFrame, DataFrame], DataFrame]


def merge(store: Store, table: str, keys: list[str], fold: Fold, rows: DataFrame, tag: str) -> int:
    """Fold ``rows`` (which have ``keys``) into a stored table; ``fold(held, rows)`` gives the new rows of those keys."""
    if any(entry["tag"] == tag for _, entry in store.log()):
        return store.version()
    rows = materialize(rows, "batch")
    seen = store.version()
    held = store.read(table, seen).join(rows.select(*keys).distinct(), keys, "left_semi")
    after = materialize(fold(held, rows), "merged")
    return store.commit(*store.replace(table, keys, after), expect=seen, tag=tag)


def keep(stream: DataFrame, store: Store, table: str, keys: list[str], fold: Fold, name: str, checkpoint: str) -> StreamingQuery:
    """Run a stream into a stored table over all there is now; ``name`` tells streams into one store apart."""
    write = stream.writeStream.foreachBatch(lambda rows, number: merge(store, table, keys, fold, rows, f"{name}:{number}") and None)
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_period(replies: DataFrame) -> DataFrame:
    return replies.withColumn("period", period(F.col("ts")))


def fold_usage(held: DataFrame, replies: DataFrame) -> DataFrame:
    """Counters of accounts and months after more replies ``(account, period, overage)``."""
    new = replies.groupBy("account", "period").agg(F.count("*").alias("n"), F.sum(F.when(F.col("overage"), OVERAGE_USD).otherwise(0.0)).alias("usd"))
    both = new.join(held, ["account", "period"], "left")
    return both.select("account", "period", (F.coalesce("ai_replies_used", F.lit(0)) + F.col("n")).alias("ai_replies_used"), (F.coalesce("overage_usd", F.lit(0.0)) + F.col("usd")).alias("overage_usd"))


def with_normal_form(questions: DataFrame) -> DataFrame:
    """Questions with the form they are grouped by; those without any are no gap."""
    return questions.withColumn("question_normalized", normalize_arabic(F.col("question"))).where("question_normalized <> ''")


def fold_gaps(held: DataFrame, questions: DataFrame) -> DataFrame:
    """Gaps after more unanswered questions ``(workspace, question_normalized, question, language, similarity, seq, at)``.

    A gap keeps its first wording, counts up, and keeps its nearest miss; asked again, an
    answered one stays answered.
    """
    first = lambda c: F.min_by(c, "seq").alias(f"new_{c}")
    keys = ["workspace", "question_normalized"]
    new = questions.groupBy(*keys).agg(F.count("*").alias("n"), F.max("similarity").cast("double").alias("near"), first("question"), first("language"), F.min("at").alias("from"), F.max("at").alias("to"))
    both = new.join(held, keys, "left")
    return both.select(
        *keys, F.coalesce("question", "new_question").alias("question"), F.coalesce("language", "new_language").alias("language"), (F.coalesce("count", F.lit(0)) + F.col("n")).alias("count"),
        F.greatest("best_similarity", "near").alias("best_similarity"), F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce("created", "from").alias("created"), F.greatest("updated", "to").alias("updated"),
    )


def fold_escalations(held: DataFrame, requests: DataFrame) -> DataFrame:
    """One escalation per conversation after more requests ``(conversation, workspace, lead, seq, at)``: the newest lead; a resolved one is pending again."""
    new = requests.groupBy("conversation").agg(F.max_by("workspace", "seq").alias("new_workspace"), F.max_by("lead", "seq").alias("new_lead"), F.min("at").alias("from"), F.max("at").alias("to"))
    both = new.join(held, "conversation", "left")
    status = F.when(F.coalesce("status", F.lit("resolved")) == "resolved", "pending").otherwise(F.col("status"))
    return both.select(
        F.coalesce("workspace", "new_workspace").alias("workspace"), "conversation", F.coalesce("new_lead", "lead").alias("lead"), status.alias("status"),
        F.coalesce("assigned_to", F.lit("")).alias("assigned_to"), F.coalesce("reason", F.lit("")).alias("reason"), "notified_at", F.coalesce("created", "from").alias("created"), F.col("to").alias("updated"),
    )


def fold_ledger(held: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger rows after more deliveries ``(event_id, type, account, result, seq, at)``: each id as first delivered."""
    first = events.groupBy("event_id").agg(F.min_by(F.struct("type", "account", "result", F.col("at").alias("created")), "seq").alias("x")).select("event_id", "x.*")
    return held.unionByName(first.join(held.select("event_id"), "event_id", "left_anti"))
