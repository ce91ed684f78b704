"""Structured Streaming forms of the batch folds; each ends equal to its batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.usage import OVERAGE_USD, gap_fold

# Subscribers of a conversation, and events that wait for one.
SUBSCRIBERS, BUFFER = 8, 16


def usage_stream(replies: DataFrame, delay: str = "40 days") -> DataFrame:
    """Running monthly usage (update or append mode); months leave the state once they are closed.

    The event time is the month's first day, so a month is closed when one has begun
    that lies ``delay`` later; replies that arrive after that are too late to count.
    """
    month = replies.withColumn("month", F.date_trunc("month", F.to_utc_timestamp("ts", F.current_timezone()))).withWatermark("month", delay)
    spent = F.sum(F.when(F.col("overage"), OVERAGE_USD).otherwise(0.0)).alias("overage_usd")
    return month.groupBy("account", "month").agg(F.count("*").alias("replies"), spent).select("account", F.date_format("month", "yyyy-MM").alias("period"), "replies", "overage_usd")


def gap_stream(questions: DataFrame, order_col: str) -> DataFrame:
    return gap_fold(questions, order_col)


def ledger_stream(events: DataFrame, ts_col: str, delay: str = "30 days") -> DataFrame:
    """Each event id once within the watermark, after which it leaves the state; ``stored.fold_ledger`` has no such bound."""
    return events.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["event_id"])


def published(messages: DataFrame) -> DataFrame:
    """Messages that go out live: those a person wrote."""
    return messages.where("role = 'human'")


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events to the first subscribers of their conversation (a stream joined to a static table)."""
    n = F.expr("row_number() OVER (PARTITION BY conversation ORDER BY subscriber)")
    allowed = subscriptions.withColumn("__n", n).where(F.col("__n") <= SUBSCRIBERS).drop("__n")
    return events.join(allowed, "conversation")


def deliver(batch: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Per subscriber of one micro-batch: events delivered and dropped, as a full buffer drops and never blocks."""
    n = F.count("*")
    return batch.groupBy("subscriber").agg(F.least(n, F.lit(buffer)).alias("delivered"), F.greatest(n - buffer, F.lit(0)).alias("dropped"))


def not_replayed(live: DataFrame, history: DataFrame, ts_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Live events (a stream) that the history a client was sent did not hold, each id once.

    Repeats of an id come close to it, so ids are forgotten ``delay`` after their event.
    """
    return live.join(history.select("id"), "id", "left_anti").withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["id"])


def status_events(conversations: DataFrame) -> DataFrame:
    """Every update of a conversation goes out as a status event."""
    return conversations.select("conversation", F.lit("status").alias("kind"), "status", "created_ms")


def events(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """What goes out live: people's messages and status changes, in one stream."""
    sent = published(messages).select("conversation", F.lit("message").alias("kind"), F.lit("").alias("status"), "created_ms")
    return sent.unionByName(status_events(conversations))


def with_human(events: DataFrame) -> DataFrame:
    """Whether a person has each conversation, by its latest status."""
    status = F.max_by("status", "created_ms")
    return events.where("kind = 'status'").groupBy("conversation").agg(status.isin("human", "escalated").alias("with_human"))


def gauges(subscriptions: DataFrame, dropped: DataFrame) -> DataFrame:
    """Subscribers, conversations watched, and events dropped."""
    seen = subscriptions.agg(F.count("*").alias("subscribers"), F.countDistinct("conversation").alias("conversations"))
    return seen.join(dropped.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")))
