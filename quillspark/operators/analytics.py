"""Conversation analytics over a sliding window of days; times are epoch milliseconds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.times import month_start
from quillspark.operators.retrieval import require_tenant
from quillspark.sources.shared import materialize

DAY_MS = 86_400_000


def days_or_default(days: object) -> int:
    """1 to 365 days; anything else means 30."""
    try:
        n = int(days)
    except (TypeError, ValueError):
        return 30
    return n if 1 <= n <= 365 else 30


def in_window(created: Column, now_ms: int, days: object = 30) -> Column:
    return created >= F.lit(now_ms - days_or_default(days) * DAY_MS)


def month_start_ms(now_ms: int) -> Column:
    """Epoch milliseconds at which the UTC month of a time began."""
    now = F.timestamp_millis(F.lit(now_ms))
    return F.unix_millis(F.from_utc_timestamp(month_start(F.to_utc_timestamp(now, F.current_timezone())), F.current_timezone()))


def workspace_counts(workspaces: DataFrame, sources: DataFrame, messages: DataFrame, conversations: DataFrame, now_ms: int, days: object = 30) -> DataFrame:
    """Of every workspace: sources, the assistant's messages since the month began, and conversations of the last days."""
    n = lambda rows, name: rows.groupBy("workspace").agg(F.count("*").alias(name))
    said = messages.where((F.col("role") == "assistant") & (F.col("created_ms") >= month_start_ms(now_ms)))
    parts = [n(sources, "sources"), n(said, "replies"), n(scoped(conversations, None, now_ms, days), "conversations")]
    rows = workspaces.select("workspace")
    for part in parts:
        rows = rows.join(part, "workspace", "left")
    return rows.select("workspace", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sources", "replies", "conversations")))


def scoped(rows: DataFrame, workspace: object | None, now_ms: int | None = None, days: object = 30) -> DataFrame:
    if workspace is not None:
        rows = rows.where(F.col("workspace") == F.lit(require_tenant(workspace)))
    return rows if now_ms is None else rows.where(in_window(F.col("created_ms"), now_ms, days))


def status_counts(conversations: DataFrame) -> DataFrame:
    """Conversations per workspace: all, and by the statuses a summary shows."""
    n = lambda s: F.count_if(F.col("status") == s)
    return conversations.groupBy("workspace").agg(F.count("*").alias("conversations"), n("auto_resolved").alias("auto_resolved"), n("escalated").alias("escalated"), n("human").alias("human"))


def resolutions(conversations: DataFrame) -> DataFrame:
    rows = conversations.where("status = 'auto_resolved' and resolution_signal != ''")
    return rows.groupBy("workspace", "resolution_signal").agg(F.count("*").alias("n"))


def languages(conversations: DataFrame) -> DataFrame:
    return conversations.where("language != ''").groupBy("workspace", "language").agg(F.count("*").alias("n"))


def outcomes(messages: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("outcome") == s)
    return messages.groupBy("workspace").agg(n("answered").alias("answered"), n("refused").alias("unanswered"))


def ratings(messages: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("rating") == s)
    return messages.groupBy("workspace").agg(n("up").alias("up"), n("down").alias("down"))


def first_responses(messages: DataFrame) -> DataFrame:
    """First visitor message and first reply of every conversation."""
    user = F.min(F.when(F.col("role") == "user", F.col("created_ms")))
    reply = F.min(F.when(F.col("role").isin("assistant", "human"), F.col("created_ms")))
    return messages.groupBy("workspace", "conversation").agg(user.alias("first_user_ms"), reply.alias("first_reply_ms"))


def exact_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, median)`` of whole numbers, nulls left out: the middle value, or the mean of the two.

    Equal values are counted first, so no value is hot.  The counts are cut into
    ranges of key and value, each range adds up what lies before it, and the ranges
    that hold the middle give it: two shuffles, whatever a key's share of the rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    parts = materialize(counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "medians")
    held = parts.groupBy("k", "part").agg(F.sum("n").alias("here"))
    sums = held.selectExpr("k", "part", "sum(here) OVER (PARTITION BY k ORDER BY part) - here AS before", "sum(here) OVER (PARTITION BY k) AS total", "here")
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    middle = sums.where((F.col("before") <= high) & (F.col("before") + F.col("here") > low))
    near = parts.join(middle, ["k", "part"])
    upto = near.withColumn("upto", F.col("before") + F.expr("sum(n) OVER (PARTITION BY k, part ORDER BY v)"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    found = upto.groupBy("k").agg(at(low).alias("low"), at(high).alias("high"))
    return found.select(F.col("k").alias(key), ((F.col("low") + F.col("high")) / 2).alias("median"))


def median_response(pairs: DataFrame) -> DataFrame:
    """Whole milliseconds of the median positive wait; null where there is none."""
    waits = pairs.withColumn("wait", F.col("first_reply_ms") - F.col("first_user_ms")).select("workspace", F.when(F.col("wait") > 0, F.col("wait")).alias("wait"))
    found = exact_medians(waits, "workspace", "wait").select("workspace", F.floor("median").cast("long").alias("median_ms"))
    return pairs.select("workspace").distinct().join(found, "workspace", "left")


def counted_map(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("workspace").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(f"{key}_map"))


def _mapped(kinds: Column, field: str, condition: Callable[[Column], Column]) -> Column:
    """Counts by a field of the kinds (arrays of a closed vocabulary, so short) that meet a condition, as a map."""
    own = F.filter(kinds, condition)
    total = lambda word: F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + F.when(x[field] == word, x["n"]).otherwise(0))
    words = F.sort_array(F.array_distinct(F.transform(own, lambda x: x[field])))
    return F.map_from_entries(F.transform(words, lambda w: F.struct(w.alias("word"), total(w).alias("n"))))


def conversation_figures(conversations: DataFrame) -> DataFrame:
    """All figures that conversations give, in one pass: counts by status, and maps of resolutions and languages."""
    kinds = conversations.groupBy("workspace", "status", "resolution_signal", "language").agg(F.count("*").alias("n"))
    n = lambda status: F.sum(F.when(F.col("status") == status, F.col("n")).otherwise(0)).alias(status)
    each = kinds.groupBy("workspace").agg(F.sum("n").alias("conversations"), n("auto_resolved"), n("escalated"), n("human"), F.collect_list(F.struct("status", "resolution_signal", "language", "n")).alias("kinds"))
    solved = _mapped(F.col("kinds"), "resolution_signal", lambda x: (x["status"] == "auto_resolved") & (x["resolution_signal"] != ""))
    spoken = _mapped(F.col("kinds"), "language", lambda x: x["language"] != "")
    return each.select("workspace", "conversations", "auto_resolved", "escalated", "human", solved.alias("resolution_signal_map"), spoken.alias("language_map"))


def message_figures(messages: DataFrame) -> DataFrame:
    """All figures that messages give, in one pass by conversation: outcomes, ratings, and the median first response."""
    n = lambda column, word: F.count_if(F.col(column) == word)
    user = F.min(F.when(F.col("role") == "user", F.col("created_ms")))
    reply = F.min(F.when(F.col("role").isin("assistant", "human"), F.col("created_ms")))
    counted = {"answered": n("outcome", "answered"), "unanswered": n("outcome", "refused"), "up": n("rating", "up"), "down": n("rating", "down")}
    each = materialize(messages.groupBy("workspace", "conversation").agg(user.alias("first_user_ms"), reply.alias("first_reply_ms"), *(c.alias(name) for name, c in counted.items())), "conversation-figures")
    return each.groupBy("workspace").agg(*(F.sum(name).alias(name) for name in counted)).join(median_response(each), "workspace", "left")


def summary(conversations: DataFrame, messages: DataFrame, leads: DataFrame, gaps: DataFrame, workspace: object | None, now_ms: int, days: object = 30) -> DataFrame:
    """One row per workspace with every figure of the dashboard; open gaps are not windowed, maps are never null."""
    c, m, ld = (scoped(x, workspace, now_ms, days) for x in (conversations, messages, leads))
    g = scoped(gaps, workspace).where(~F.col("answered"))
    parts = [conversation_figures(c), message_figures(m), ld.groupBy("workspace").agg(F.count("*").alias("leads")), g.groupBy("workspace").agg(F.count("*").alias("open_gaps"))]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = ["conversations", "auto_resolved", "escalated", "human", "answered", "unanswered", "up", "down", "leads", "open_gaps"]
    maps = ["resolution_signal_map", "language_map"]
    one = lambda name: F.first(name, ignorenulls=True)  # noqa: E731  # a workspace has one row of each part at most
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    whole = together.groupBy("workspace").agg(*(F.coalesce(one(n), F.lit(0).cast("long")).alias(n) for n in counts), *(F.coalesce(one(n), none).alias(n) for n in maps), one("median_ms").alias("median_ms"))
    return whole


def percent(part: Column, whole: Column) -> Column:
    """Rounded share in percent, 0 of nothing."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0))), F.lit(0.0)).cast("long")


def duration_label(ms: Column) -> Column:
    return (
        F.when(ms.isNull(), "—")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.round(ms / 1000).cast("long").cast("string"), F.lit("s")))
        .when(ms < 3_600_000, F.concat(F.round(ms / 60_000).cast("long").cast("string"), F.lit("m")))
        .otherwise(F.concat(F.round(ms / 3_600_000, 1).cast("string"), F.lit("h")))
    )


def last_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of every conversation, in order; the top-n prunes before its shuffle."""
    ranked = messages.withColumn("back", F.expr("row_number() OVER (PARTITION BY conversation ORDER BY created_ms DESC, turn DESC)"))
    return ranked.where(F.col("back") <= n)


def inbox(conversations: DataFrame) -> DataFrame:
    """Waiting conversations first, then the latest."""
    waiting = F.when(F.col("status").isin("escalated", "human"), 0).otherwise(1)
    return conversations.orderBy(waiting, F.desc("created_ms"), "conversation")
