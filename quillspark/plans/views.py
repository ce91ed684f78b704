"""The knowledge-base tables, bound to the test tables by SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.shared import spread

VIEWS = {
    "messages": """
SELECT conv_id % 8 AS workspace, conv_id AS conversation, turn,
  CASE role WHEN 'system' THEN 'human' ELSE role END AS role, text,
  CASE WHEN role = 'assistant' THEN CASE (conv_id * 7 + turn) % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'blocked' ELSE 'answered' END ELSE '' END AS outcome,
  CASE WHEN role = 'assistant' THEN CASE (conv_id * 3 + turn) % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE '' END ELSE '' END AS rating,
  1704067200000 + conv_id * 3600000 + turn * (1000 + (conv_id * 37) % 9000) AS created_ms
FROM {conversations}""",
    "conversations": """
SELECT DISTINCT conv_id AS conversation, conv_id % 8 AS workspace,
  CASE conv_id % 5 WHEN 0 THEN 'auto_resolved' WHEN 1 THEN 'escalated' WHEN 2 THEN 'human' WHEN 3 THEN 'closed' ELSE 'active' END AS status,
  CASE WHEN conv_id % 5 = 0 THEN CASE conv_id % 3 WHEN 0 THEN 'rated_helpful' WHEN 1 THEN 'user_confirmed' ELSE '' END ELSE '' END AS resolution_signal,
  CASE conv_id % 4 WHEN 0 THEN 'ar' WHEN 1 THEN '' ELSE 'en' END AS language,
  1704067200000 + conv_id * 3600000 AS created_ms
FROM {conversations}""",
    "leads": "SELECT conv_id % 8 AS workspace, conv_id AS conversation, conv_id * 100 + turn AS lead, 1704067200000 + conv_id * 3600000 AS created_ms FROM {conversations} WHERE role = 'user' AND turn > 2",
    "questions": """
SELECT conv_id % 8 AS workspace, conv_id * 100 + turn AS seq, text AS question, CASE conv_id % 4 WHEN 0 THEN 'ar' ELSE 'en' END AS language,
  ((conv_id * 7 + turn) % 100) / 100.0 AS similarity, conv_id % 3 = 0 AS answered
FROM {conversations} WHERE role = 'user'""",
    "vectors": "SELECT label AS workspace_id, vec_id AS chunk_id, embedding FROM {embeddings}",
    "accounts": "SELECT r_regionkey AS account, r_name AS account_name FROM {region}",
    "workspaces": "SELECT n_nationkey AS workspace, n_regionkey AS account, n_name AS name FROM {nation}",
    "memberships": """
SELECT c_nationkey AS workspace, c_custkey % 97 AS usr,
  CASE min(c_custkey) % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'agent' END AS role, min(c_custkey) AS created_ms
FROM {customer} GROUP BY c_nationkey, c_custkey % 97""",
    "users": "SELECT DISTINCT c_custkey % 97 AS usr, concat('user', CAST(c_custkey % 97 AS VARCHAR(9)), '@example.com') AS email, '' AS name FROM {customer}",
    "invitations": "SELECT s_nationkey AS workspace, concat('User', CAST(s_suppkey % 200 AS VARCHAR(9)), '@example.com') AS email, s_suppkey * 1000 AS expires_ms, s_suppkey AS created_ms FROM {supplier}",
    "replies": "SELECT o_custkey AS account, o_orderdate AS ts, o_orderkey AS seq, o_orderkey % 5 = 0 AS overage FROM {orders}",
    "metered": "SELECT o_custkey % 50 AS account, o_orderdate AS ts, o_orderkey AS seq FROM {orders}",
    "ledger_events": "SELECT CAST(event_id % 1000 AS VARCHAR(20)) AS event_id, event_id AS seq, event_type AS type, ts FROM {events}",
}


#: Tables whose rows cost much more work than reading them does.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A knowledge-base table; ``usr`` columns are named ``user``."""
    sql = VIEWS[name]
    rows = spark.sql(sql, **{t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", sql)})
    return rows.withColumnRenamed("usr", "user")


def with_views(body: str) -> str:
    """SQL for the other engine: ``body`` after the views it names as ``v_…``."""
    used = [n for n in VIEWS if re.search(rf"\bv_{n}\b", body)]
    heads = [f"v_{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n]).strip()})" for n in used]
    own = re.match(r"\s*WITH(\s+RECURSIVE)?\b", body)
    if not heads or not own:
        return (f"WITH {', '.join(heads)} {body}" if heads else body).strip()
    return f"WITH{own[1] or ''} {', '.join(heads)}, {body[own.end() :]}".strip()
