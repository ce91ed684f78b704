"""Tenancy: who may see and do what, seats, rosters and overviews, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_email
from quillspark.sources.shared import materialize

MANAGERS = ("owner", "admin")


def visible(rows: DataFrame, memberships: DataFrame, user: object) -> DataFrame:
    """Rows of the workspaces a user is a member of."""
    return rows.join(memberships.where(F.col("user") == F.lit(user)).select("workspace"), "workspace", "left_semi")


def manageable(rows: DataFrame, memberships: DataFrame, user: object) -> DataFrame:
    """Rows of the workspaces where one and the same membership is the user's and a manager's."""
    own = memberships.where((F.col("user") == F.lit(user)) & F.col("role").isin(*MANAGERS))
    return rows.join(own.select("workspace"), "workspace", "left_semi")


def account_members(memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    return memberships.join(workspaces, "workspace").select("account", "user").distinct()


def live(invitations: DataFrame, now_ms: int) -> DataFrame:
    return invitations.where(F.col("expires_ms") > F.lit(now_ms))


def seats(memberships: DataFrame, workspaces: DataFrame, users: DataFrame, invitations: DataFrame, now_ms: int) -> DataFrame:
    """Seats used per account: distinct members, and distinct invited addresses that are no member's."""
    people = account_members(memberships, workspaces)
    mails = people.join(users, "user").select("account", F.lower("email").alias("email"))
    asked = live(invitations, now_ms).join(workspaces, "workspace").select("account", F.lower("email").alias("email")).distinct()
    pending = asked.join(mails, ["account", "email"], "left_anti")
    n = lambda rows, name: rows.groupBy("account").agg(F.count("*").alias(name))
    both = n(people, "members").join(n(pending, "pending"), "account", "full")
    members, waiting = F.coalesce("members", F.lit(0)), F.coalesce("pending", F.lit(0))
    return both.select("account", members.alias("members"), waiting.alias("pending"), (members + waiting).alias("seats"))


def slots_left(used: Column, limit: Column) -> Column:
    """What is left of a limit; a limit of nothing leaves nothing."""
    return F.when(limit <= 0, 0).otherwise(F.greatest(limit - used, F.lit(0)))


def under_source_limit(used: Column, limit: Column) -> Column:
    """Sources are different: no limit means none applies."""
    return (limit <= 0) | (used < limit)


def can_assign(actor: Column, target: Column) -> Column:
    return ((actor == "owner") & target.isin("admin", "agent")) | ((actor == "admin") & (target == "agent"))


def can_remove(actor: Column, target: Column, himself: Column) -> Column:
    return (target != "owner") & (himself | (actor == "owner") | ((actor == "admin") & (target == "agent")))


def preferred_memberships(memberships: DataFrame) -> DataFrame:
    """One membership per user: by role as text, descending (owner, agent, admin), then the oldest."""
    best = Window.partitionBy("user").orderBy(F.desc("role"), "created_ms", "workspace")
    return memberships.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def owned_accounts(memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The account of each user's oldest ownership."""
    best = Window.partitionBy("user").orderBy("created_ms", "workspace")
    first = memberships.where("role = 'owner'").withColumn("n", F.row_number().over(best)).where("n = 1")
    return first.join(workspaces, "workspace").select("user", "account")


def shared_workspaces(memberships: DataFrame, workspaces: DataFrame, accounts: DataFrame) -> DataFrame:
    """Workspaces a user works in that belong to an account other than the user's own."""
    own = owned_accounts(memberships, workspaces).withColumnRenamed("account", "owned")
    rows = memberships.join(workspaces, "workspace").join(accounts, "account", "left").join(own, "user", "left")
    return rows.where(~F.col("account").eqNullSafe(F.col("owned"))).select("user", "workspace", "role", "account", F.coalesce("account_name", F.lit("")).alias("account_name"))


def overview(workspaces: DataFrame, memberships: DataFrame, user: object, *counts: DataFrame) -> DataFrame:
    """Workspaces with the user's role ('' if none) and pre-aggregated counts (0 if none)."""
    roles = memberships.where(F.col("user") == F.lit(user)).select("workspace", "role")
    rows = workspaces.join(roles, "workspace", "left").withColumn("role", F.coalesce("role", F.lit("")))
    for part in counts:
        name = next(c for c in part.columns if c != "workspace")
        rows = rows.join(part, "workspace", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return rows


def team(memberships: DataFrame, users: DataFrame) -> DataFrame:
    return memberships.join(users, "user").orderBy("created_ms", "user")


def invitation_preview(invitations: DataFrame, workspaces: DataFrame, users: DataFrame, now_ms: int, label_col: str = "name") -> DataFrame:
    """What an invitation shows: workspace, who invites (name, else address), and whether it still holds."""
    by = users.select(F.col("user").alias("invited_by"), F.coalesce(F.nullif(F.trim(label_col), F.lit("")), F.col("email")).alias("inviter"))
    rows = invitations.join(workspaces, "workspace").join(by, "invited_by", "left")
    return rows.withColumn("status", F.when(F.col("expires_ms") > F.lit(now_ms), 200).otherwise(410))


def latest_invitations(invitations: DataFrame) -> DataFrame:
    """Inviting the same address again replaces the earlier invitation; bad addresses are refused."""
    rows = invitations.withColumn("email", normalize_email(F.col("email"))).where("email is not null")
    best = Window.partitionBy("workspace", "email").orderBy(F.desc("created_ms"))
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def without_workspace(tables: dict[str, DataFrame], workspaces: DataFrame, doomed: object, account: object) -> dict[str, DataFrame]:
    """Tables without one workspace's rows; refused if it is the account's last."""
    if not workspaces.where((F.col("account") == F.lit(account)) & (F.col("workspace") != F.lit(doomed))).take(1):
        raise ValueError("an account keeps at least one workspace")
    return {name: rows.where(F.col("workspace") != F.lit(doomed)) for name, rows in tables.items()}


def provision(users: DataFrame) -> dict[str, DataFrame]:
    """Account, workspace and owner membership of every new user."""
    from quillspark.functions.text import display_name

    named = users.withColumn("label", display_name(F.col("name"), F.col("email")))
    account, workspace = F.concat(F.lit("a-"), F.col("user").cast("string")), F.concat(F.lit("w-"), F.col("user").cast("string"))
    return {
        "accounts": named.select(account.alias("account"), F.col("label").alias("account_name"), F.lit("free").alias("plan"), F.lit("direct").alias("kind")),
        "workspaces": named.select(workspace.alias("workspace"), account.alias("account"), F.col("label").alias("name")),
        "memberships": named.select(workspace.alias("workspace"), "user", F.lit("owner").alias("role")),
    }


def member_emails(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Addresses of a workspace's members; users without one are left out."""
    return memberships.join(users, "user").where("coalesce(email, '') != ''").select("workspace", "email")


# Fixed value: characters of a workspace's name.
NAME = 120


def create_workspaces(requests: DataFrame, memberships: DataFrame, workspaces: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests ``(user, seq, name)`` to add a workspace to the account a user owns, with ``account`` and ``result``.

    ``limits(account, max_workspaces)``.  Requests of an account count in order;
    as long as slots are left each takes one; by its meaning one task goes through them.
    """
    used = workspaces.groupBy("account").agg(F.count("*").alias("used"))
    own = owned_accounts(memberships, workspaces).join(used, "account", "left").join(limits, "account", "left")
    rows = requests.withColumn("name", F.left(F.trim("name"), F.lit(NAME))).join(own, "user", "left")
    valid = (F.col("name") != "") & F.col("account").isNotNull()
    place = F.expr("sum(CASE WHEN __valid THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY seq)")
    rows = rows.withColumn("__valid", valid).withColumn("__place", place)
    left = slots_left(F.col("used"), F.col("max_workspaces"))
    result = F.when(F.col("name") == "", "a workspace name is required").when(F.col("account").isNull(), "only the account owner can add a workspace").when(F.col("__place") > left, "no slots left").otherwise("created")
    return rows.select("user", "seq", "name", "account", result.alias("result"))


def accept_invitations(attempts: DataFrame, users: DataFrame, memberships: DataFrame, workspaces: DataFrame, limits: DataFrame, now_ms: int, order_col: str = "seq") -> DataFrame:
    """What becomes of each attempt at an invitation, in order: ``(invitation, user, workspace, role, seq, result)``.

    ``attempts(invitation, user, workspace, email, expires_ms, role, seq)``, seq unique;
    ``limits(account, max_members, invites)``.  Members already in the workspace just
    use their invitation up.  A seat is checked when it is taken: users new to an
    account take its last seats in the order of their first valid attempt, and seats
    are never given back in between, so a user has a seat if fewer others came
    before.  A used invitation isn't found again.
    """
    members = account_members(memberships, workspaces)
    seats_used = members.groupBy("account").agg(F.count("*").alias("members"))
    inside = memberships.select("workspace", "user").distinct().withColumn("inside", F.lit(True))
    seated = members.withColumn("seated", F.lit(True))
    rows = attempts.select("invitation", "user", "workspace", "email", "expires_ms", "role", F.col(order_col).alias("seq"))
    rows = rows.join(users.select("user", F.col("email").alias("own")), "user").join(workspaces.select("workspace", "account"), "workspace")
    rows = rows.join(inside, ["workspace", "user"], "left").join(seated, ["account", "user"], "left").join(seats_used, "account", "left").join(limits, "account", "left")
    early = (
        F.when(F.col("expires_ms") <= now_ms, "expired")
        .when(F.lower("own") != F.lower("email"), "for another address")
        .when(F.col("inside"), "already a member")
        .when(~F.coalesce("invites", F.lit(False)), "not on this plan")
    )
    rows = rows.withColumns({"early": early, "free": slots_left(F.coalesce("members", F.lit(0)), F.coalesce("max_members", F.lit(0)))})
    rows = materialize(rows.select("invitation", "user", "workspace", "role", "seq", "account", "seated", "early", "free"), "attempts")
    # New users of an account by their first valid attempt; no more than the largest number of free seats are ranked.
    newcomers = rows.where("early is null and seated is null").groupBy("account", "user").agg(F.min("seq").alias("first"), F.max("free").alias("free"))
    most = newcomers.agg(F.max("free")).first()[0] or 0
    turn = F.row_number().over(Window.partitionBy("account").orderBy("first"))
    admitted = newcomers.withColumn("turn", turn).where(F.col("turn") <= F.lit(most)).where("turn <= free").select("account", "user", F.lit(True).alias("admitted"))
    rows = rows.join(admitted, ["account", "user"], "left")
    joins = F.col("early").isNull() & (F.col("seated") | F.col("admitted"))
    before = Window.partitionBy("workspace", "user").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce(F.max(F.coalesce(joins, F.lit(False))).over(before), F.lit(False))
    result = F.coalesce("early", F.when(~F.coalesce(joins, F.lit(False)), "team is full").when(again, "already a member").otherwise("joined"))
    rows = rows.withColumn("result", result)
    uses = F.col("result").isin("joined", "already a member")
    earlier = Window.partitionBy("invitation").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.max(uses).over(earlier), F.lit(False))
    return rows.select("invitation", "user", "workspace", "role", "seq", F.when(used, "not found").otherwise(F.col("result")).alias("result"))


def without_invitations(invitations: DataFrame, gone: DataFrame) -> DataFrame:
    """Invitations left after some were revoked or used up."""
    return invitations.join(gone.select("invitation"), "invitation", "left_anti")
