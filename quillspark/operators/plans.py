"""Plan catalogue: limits and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The plans' limits.
LIMITS = [
    # plan, replies, workspaces, websites, members, sources, chunks, pages per crawl, retention days
    ("free", 50, 1, 1, 1, 5, 500, 20, 30),
    ("starter", 1000, 1, 1, 1, 50, 10000, 100, 90),
    ("growth", 4000, 1, 3, 5, 200, 50000, 300, 180),
    ("pro", 10000, 3, 10, 15, 1000, 200000, 1000, 365),
    ("agency", 25000, 20, 20, 25, 1000, 200000, 1000, 365),
]
LIMIT_COLUMNS = ["plan", "replies", "workspaces", "websites", "members", "sources", "chunks", "pages", "retention_days"]
# The plan from which on a feature is sold, and features sold but not built.
FEATURES = {
    "starter": ("basicAnalytics", "leadCapture", "emailEscalation"),
    "growth": ("advancedAnalytics", "removeBranding", "knowledgeGaps", "humanTakeover", "autoSourceRefresh", "multipleMembers"),
    "pro": ("apiAccess", "advancedActions", "prioritySupport"),
    "agency": ("clientWorkspaces", "whiteLabel", "clientInvitations", "brandedReports", "workspaceDuplication"),
}
UNSHIPPED = ("advancedActions",)


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, f"plan string, {', '.join(f'{c} bigint' for c in LIMIT_COLUMNS[1:])}")


def with_limits(rows: DataFrame) -> DataFrame:
    """Rows with the limits of their ``plan``; an unknown plan has those of the free one.  The catalogue is five rows."""
    catalogue = limits(rows.sparkSession)
    known = F.when(F.col("plan").isin(*(r[0] for r in LIMITS)), F.col("plan")).otherwise("free")
    return rows.withColumn("__plan", known).join(F.broadcast(catalogue.withColumnRenamed("plan", "__plan")), "__plan").drop("__plan")


def features(spark: SparkSession) -> DataFrame:
    """``(plan, feature)`` that can be used: sold on the plan and built."""
    order = list(FEATURES)
    rows = [(plan, f) for i, plan in enumerate(order) for tier in order[: i + 1] for f in FEATURES[tier] if f not in UNSHIPPED]
    return spark.createDataFrame(rows, "plan string, feature string")


def having(rows: DataFrame, feature: str) -> DataFrame:
    """Rows whose plan has a feature."""
    return rows.join(F.broadcast(features(rows.sparkSession).where(F.col("feature") == feature).select("plan")), "plan", "left_semi")


def handoff_enabled(rows: DataFrame) -> DataFrame:
    """Rows whose plan escalates by mail or lets a person take over."""
    able = features(rows.sparkSession).where(F.col("feature").isin("emailEscalation", "humanTakeover")).select("plan").distinct()
    return rows.join(F.broadcast(able), "plan", "left_semi")
