"""Explicit schemas of the knowledge-base tables, and checks of closed vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables' columns and the vocabularies of their enumerations.
TABLES = {
    "accounts": "account string, name string, kind string, plan string, hard_cap_usd double, stripe_customer_id string, stripe_subscription_id string, subscription_status string, stripe_price_id string, current_period_end timestamp, cancel_at_period_end boolean, created timestamp, updated timestamp",
    "workspaces": "workspace string, name string, account string, widget_key string, widget_config string, allowed_domains string, retention_days bigint, created timestamp, updated timestamp",
    "memberships": "workspace string, user string, role string, created timestamp",
    "sources": "source string, workspace string, type string, title string, url string, status string, error string, pages bigint, last_refreshed timestamp, created timestamp, updated timestamp",
    "chunks": "chunk string, workspace string, source string, text string, text_normalized string, position bigint, embedding array<float>, created timestamp",
    "conversations": "conversation string, workspace string, channel string, language string, status string, resolution_signal string, visitor string, created timestamp, updated timestamp",
    "messages": "message string, workspace string, conversation string, role string, text string, sources_used string, outcome string, confidence double, rating string, created timestamp",
    "usage": "account string, period string, ai_replies_used bigint, overage_usd double",
    "knowledge_gaps": "workspace string, question string, question_normalized string, language string, count bigint, best_similarity double, answered boolean, created timestamp, updated timestamp",
    "leads": "lead string, workspace string, conversation string, name string, contact string, contact_kind string, question string, created timestamp",
    "escalations": "workspace string, conversation string, lead string, status string, assigned_to string, reason string, notified_at timestamp, created timestamp, updated timestamp",
    "billing_events": "event_id string, type string, account string, result string, created timestamp",
    "invitations": "workspace string, email string, role string, token_hash string, invited_by string, expires timestamp, created timestamp",
}
ENUMS = {
    "accounts": {"kind": ("direct", "agency"), "plan": ("free", "starter", "growth", "pro", "agency")},
    "memberships": {"role": ("owner", "admin", "agent")},
    "sources": {"type": ("website", "pdf", "text", "faq"), "status": ("queued", "fetching", "processing", "ready", "failed", "stale")},
    "conversations": {
        "channel": ("website", "whatsapp", "messenger"), "language": ("", "ar", "en"), "status": ("active", "auto_resolved", "escalated", "human", "closed"),
        "resolution_signal": ("", "rated_helpful", "action_completed", "user_confirmed", "ended_answered"),
    },
    "messages": {"role": ("user", "assistant", "human"), "outcome": ("", "answered", "refused", "clarify", "escalated", "blocked"), "rating": ("", "up", "down")},
    "leads": {"contact_kind": ("email", "phone", "other")},
    "escalations": {"status": ("pending", "notified", "assigned", "resolved")},
    "invitations": {"role": ("admin", "agent")},
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its declared schema; strings that are null read as unset ('')."""
    rows = spark.read.schema(TABLES[name]).parquet(path)
    return rows.fillna("", subset=[c for c, kind in rows.dtypes if kind == "string"])


def violations(rows: DataFrame, name: str) -> Column:
    """Names of the columns whose value is outside its vocabulary."""
    bad = [F.when(~F.col(c).isin(*words), F.lit(c)) for c, words in ENUMS.get(name, {}).items() if c in rows.columns]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def checked(rows: DataFrame, name: str) -> DataFrame:
    """Rows as they are; a value outside its column's vocabulary fails the job that reads it (null is unset)."""
    strict = {c: F.when(F.col(c).isNull() | F.col(c).isin(*words), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{name}.{c} can't be "), F.col(c)))) for c, words in ENUMS.get(name, {}).items() if c in rows.columns}
    return rows.withColumns(strict)


def write_vectors(rows: DataFrame, path: str, dims: int) -> None:
    """Chunks with their embedding in one table, by tenant: text and vector appear together or not at all."""
    sized = F.when((F.size("embedding") == dims) & (F.coalesce(F.col("workspace").cast("string"), F.lit("")) != ""), F.col("embedding")).otherwise(F.raise_error(F.lit("a vector lacks its workspace or has another width")))
    rows.withColumn("embedding", sized).write.partitionBy("workspace").mode("append").parquet(path)
