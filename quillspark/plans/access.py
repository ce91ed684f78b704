"""Queries over access rules and filters with bound parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import access, records
from quillspark.plans.views import table, view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


#: Collections as the test tables have them: the view or table, the record's id, and its workspace or account.
RECORDS = {
    "workspaces": ("v_workspaces", "workspace", "workspace"),
    "memberships": ("v_memberships", "workspace * 1000 + usr", "workspace"),
    "sources": ("supplier", "s_suppkey", "s_nationkey"),
    "chunks": ("v_vectors", "chunk_id", "workspace_id"),
    "conversations": ("v_conversations", "conversation", "workspace"),
    "messages": ("v_messages", "conversation * 1000 + turn", "workspace"),
    "leads": ("v_leads", "lead", "workspace"),
    "escalations": ("v_leads", "conversation", "workspace"),
    "knowledge_gaps": ("v_questions", "seq", "workspace"),
    "accounts": ("v_accounts", "account", "account"),
    "usage": ("v_replies", "seq", "account"),
}
BY_ACCOUNT = ("accounts", "usage")
WHO = 7


def _records(s, d, collection: str) -> DataFrame:
    name, record, owner = RECORDS[collection]
    rows = view(s, d, name[2:]) if name.startswith("v_") else table(s, d, name)
    rows = rows.withColumnRenamed("user", "usr") if "user" in rows.columns else rows
    return rows.selectExpr(f"CAST({record} AS BIGINT) AS record", f"{owner} AS {'account' if collection in BY_ACCOUNT else 'workspace'}")


def _permitted(s, d, action: str) -> DataFrame:
    """Records of every collection that one user may act on."""
    memberships, workspaces = view(s, d, "memberships"), view(s, d, "workspaces")
    parts = [access.permitted(_records(s, d, c), c, action, WHO, memberships, workspaces).select(F.lit(c).alias("collection"), "record") for c in RECORDS]
    return reduce(DataFrame.unionByName, parts)


def _permitted_sql(collections: list[str], roles: str) -> str:
    own = f"SELECT workspace FROM v_memberships WHERE usr = {WHO}{roles}"
    parts = []
    for c in collections:
        name, record, owner = RECORDS[c]
        inside = f"SELECT account FROM v_workspaces WHERE workspace IN ({own})" if c in BY_ACCOUNT else own
        parts.append(f"SELECT '{c}' AS collection, CAST({record} AS BIGINT) AS record FROM {name} WHERE {owner} IN ({inside})")
    return " UNION ALL ".join(parts)


@query(_permitted_sql(list(RECORDS), ""))
def access_list(s, d):
    """Every member reads what is of their workspaces, and their accounts'."""
    return _permitted(s, d, "list")


@query(_permitted_sql(["sources", "conversations", "leads", "escalations"], " AND role IN ('owner', 'admin')"))
def access_delete(s, d):
    """Only managers delete, and only what the backend doesn't keep to itself."""
    return _permitted(s, d, "delete")


#: Events read as requests: who, on which workspace, and what they set.
REQUESTS = """SELECT event_id, user_id % 97 AS usr, event_id % 25 AS workspace,
  CASE event_type WHEN 'click' THEN 'name' WHEN 'view' THEN 'widget_config' WHEN 'purchase' THEN 'account' WHEN 'signup' THEN 'widget_key' ELSE 'role' END AS field,
  CASE event_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'user' ELSE 'assistant' END AS given FROM {events}"""


def _requests(s, d, *fields: str) -> DataFrame:
    rows = s.sql(REQUESTS, events=table(s, d, "events"))
    field = F.col("field") if not fields else F.lit(fields[0])
    return rows.select("event_id", F.col("usr").alias("user"), "workspace", F.create_map(field, F.col("given")).alias("body"))


_ASKED = REQUESTS.replace("{events}", "events")


@query(f"""WITH q AS ({_ASKED}) SELECT event_id, field NOT IN ('account', 'widget_key') AND EXISTS (
  SELECT 1 FROM v_memberships m WHERE m.workspace = q.workspace AND m.usr = q.usr AND m.role IN ('owner', 'admin')) AS allowed FROM q""")
def access_update_workspaces(s, d):
    """Managers change their workspaces, but not whose they are nor their key."""
    found = access.judged(_requests(s, d), "workspaces", "update", view(s, d, "memberships"), view(s, d, "workspaces"))
    return found.select("event_id", "allowed")


@query(f"WITH q AS ({_ASKED}) SELECT event_id, given = 'human' AND EXISTS (SELECT 1 FROM v_memberships m WHERE m.workspace = q.workspace AND m.usr = q.usr) AS allowed FROM q")
def access_create_messages(s, d):
    """Members write as people, never as the visitor or the assistant."""
    found = access.judged(_requests(s, d, "role"), "messages", "create", view(s, d, "memberships"), view(s, d, "workspaces"))
    return found.select("event_id", "allowed")


@query("""SELECT c.conversation, c.status FROM v_conversations c WHERE c.status <> 'closed' AND c.created_ms >= 1704067200000
  AND EXISTS (SELECT 1 FROM v_workspaces w WHERE w.workspace = c.workspace AND w.account = 1) AND c.language IN ('ar', 'en') ORDER BY c.created_ms DESC, c.conversation LIMIT 20 OFFSET 3""")
def records_filtered(s, d):
    """A filter with bound parameters over a relation, and a sort string."""
    condition = "r.status <> :status AND r.created_ms >= :since AND array_contains(:languages, r.language) AND EXISTS (SELECT 1 FROM {workspaces} w WHERE w.workspace = r.workspace AND w.account = :account)"
    params = {"status": "closed", "since": 1704067200000, "languages": ["ar", "en"], "account": 1}
    found = records.find(view(s, d, "conversations"), condition, params=params, sort="-created_ms,conversation", limit=20, offset=3, workspaces=view(s, d, "workspaces"))
    return found.select("conversation", "status")
