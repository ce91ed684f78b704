"""Access rules of the collections, as Spark SQL conditions over bound parameters and relations.

A condition speaks of a record ``r`` and of the relations ``{memberships}`` and
``{workspaces}``; Catalyst turns its ``EXISTS`` into a semi-join, so a rule costs one join
whatever the number of records.  Who asks is the parameter ``:user`` for records, or the
column ``r.user`` for requests of many users at a time.  Values are only ever bound,
never part of the text, so none of them can widen a rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The same membership has to be the user's and a manager's.
_MEMBER = "EXISTS (SELECT 1 FROM {memberships} m WHERE m.workspace = r.workspace AND m.user = $who)"
_MANAGER = "EXISTS (SELECT 1 FROM {memberships} m WHERE m.workspace = r.workspace AND m.user = $who AND m.role IN ('owner', 'admin'))"
_ACCOUNT = "EXISTS (SELECT 1 FROM {workspaces} w JOIN {memberships} m ON m.workspace = w.workspace WHERE w.account = r.account AND m.user = $who)"
_UNPROTECTED = "NOT coalesce(map_contains_key(r.body, 'account'), false) AND NOT coalesce(map_contains_key(r.body, 'widget_key'), false)"

#: By collection and action; what isn't here is for the backend alone.  ``list`` holds for single views, too.
RULES = {
    "workspaces": {"list": _MEMBER, "update": f"{_MANAGER} AND {_UNPROTECTED}"},
    "memberships": {"list": _MEMBER},
    "sources": {"list": _MEMBER, "delete": _MANAGER},
    "chunks": {"list": _MEMBER},
    "conversations": {"list": _MEMBER, "update": _MEMBER, "delete": _MANAGER},
    "messages": {"list": _MEMBER, "create": f"r.body['role'] <=> 'human' AND {_MEMBER}"},
    "leads": {"list": _MEMBER, "delete": _MANAGER},
    "escalations": {"list": _MEMBER, "update": _MEMBER, "delete": _MANAGER},
    "knowledge_gaps": {"list": _MEMBER},
    "accounts": {"list": _ACCOUNT},
    "usage": {"list": _ACCOUNT},
}
ACTIONS = ("list", "create", "update", "delete")


def rule(collection: str, action: str) -> str | None:
    """The condition of an action, or None where only the backend may do it."""
    if action not in ACTIONS:
        raise ValueError(f"no such action: {action}")
    return RULES.get(collection, {}).get(action)


def _where(rows: DataFrame, condition: str, args: dict, relations: dict[str, DataFrame]) -> DataFrame:
    used = {name: df for name, df in relations.items() if f"{{{name}}}" in condition}
    return rows.sparkSession.sql(f"SELECT r.* FROM {{rows}} r WHERE {condition}", args=args, rows=rows, **used)


def permitted(rows: DataFrame, collection: str, action: str, user: object, memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Records of a collection that a user may list, update or delete; nobody signed in (None, '') gets none."""
    condition = rule(collection, action)
    if condition is None or user is None or user == "":
        return rows.where("false")
    return _where(rows, condition.replace("$who", ":user"), {"user": user}, {"memberships": memberships, "workspaces": workspaces})


def judged(requests: DataFrame, collection: str, action: str, memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Requests ``(user, workspace or account, body)`` with ``allowed``; ``body`` maps the fields that a request sets."""
    condition = rule(collection, action)
    if condition is None:
        return requests.selectExpr("*", "false AS allowed")
    condition, relations = condition.replace("$who", "r.user"), {"memberships": memberships, "workspaces": workspaces}
    good, bad = (_where(requests, c, {}, relations) for c in (condition, f"NOT ({condition})"))
    return good.selectExpr("*", "true AS allowed").unionByName(bad.selectExpr("*", "false AS allowed"))
