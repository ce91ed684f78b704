"""Conversation rows: replies, ratings, live events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import detect_language, refusal
from quillspark.operators.analytics import last_turns


def replies(decisions: DataFrame) -> DataFrame:
    """One reply row per decision with its text, whether it offers a person, and whether it is metered.

    ``outcome``, ``language``, ``status``, ``verdict``: a person's conversation
    gets silence, a denied one the refusal as ``blocked``; only answers are metered.
    """
    silent = F.col("status").isin("human", "escalated")
    outcome = F.when(silent, "human").when(F.col("verdict") == "deny", "blocked").otherwise(F.col("outcome"))
    rows = decisions.withColumn("outcome", outcome)
    told = F.when(F.col("outcome").isin("refused", "blocked"), refusal(F.col("language"))).when(F.col("outcome") == "human", "")
    return rows.withColumns({"reply": told, "offer_handoff": F.col("outcome").isin("refused", "blocked"), "metered": F.col("outcome") == "answered", "records_gap": F.col("outcome") == "refused"})


def rate(conversations: DataFrame, ratings: DataFrame) -> DataFrame:
    """Conversations after ratings: an up on an active one resolves it, a down changes nothing."""
    up = ratings.where("rating = 'up'").select("conversation").distinct().withColumn("__up", F.lit(True))
    hit = F.coalesce("__up", F.lit(False)) & (F.col("status") == "active")
    rows = conversations.join(up, "conversation", "left").withColumn("__hit", hit)
    return rows.withColumns({"resolution_signal": F.when(F.col("__hit"), "rated_helpful").otherwise(F.col("resolution_signal")), "status": F.when(F.col("__hit"), "auto_resolved").otherwise(F.col("status"))}).drop("__hit", "__up")


def live_messages(events: DataFrame) -> DataFrame:
    """What a client shows of live events: those with id, text and role; language is detected anew."""
    whole = events.where("id is not null and text is not null and role is not null")
    return whole.select("id", F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"), "text", detect_language(F.col("text"), "en")["language"].alias("language"), (F.col("outcome") == "refused").alias("refused"))


def model_turns(turns: Column, question: Column) -> Column:
    """Turns as a model gets them: people answer as the assistant, blank turns go, the question comes last."""
    kept = F.filter(turns, lambda t: F.trim(t["text"]) != "")
    said = F.transform(kept, lambda t: F.struct(F.when(t["role"].isin("assistant", "human"), "assistant").otherwise("user").alias("role"), t["text"].alias("text")))
    return F.concat(said, F.array(F.struct(F.lit("user").alias("role"), question.alias("text"))))


def owned(conversations: DataFrame, workspace: object, visitor: object) -> DataFrame:
    """Conversations that are of this workspace and of this visitor, both."""
    return conversations.where((F.col("workspace") == F.lit(workspace)) & (F.col("visitor") == F.lit(visitor)))


def find_or_create(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Requests ``(request, workspace, conversation, visitor, language)`` with the conversation they belong to and whether it is new.

    A conversation of another workspace is not found; its request opens a new one.
    """
    known = conversations.select("workspace", "conversation").distinct().withColumn("__known", F.lit(True))
    fresh = F.concat(F.lit("new-"), F.col("request").cast("string"))
    rows = requests.join(known, ["workspace", "conversation"], "left")
    return rows.withColumns({"conversation": F.when(F.col("__known"), F.col("conversation").cast("string")).otherwise(fresh), "created": F.col("__known").isNull()}).drop("__known")


def opened(found: DataFrame) -> DataFrame:
    """Rows of the conversations that ``find_or_create`` opened."""
    return found.where("created").select("conversation", "workspace", F.lit("website").alias("channel"), "language", F.lit("active").alias("status"), "visitor")


def saved_messages(messages: DataFrame, sources_col: str = "sources") -> DataFrame:
    """Message rows with the chunk ids they used as JSON (null: none were asked for); an empty outcome stays unset."""
    return messages.withColumns({"sources_used": F.to_json(sources_col), "outcome": F.nullif(F.col("outcome"), F.lit(""))}).drop(sources_col)


def inbox_detail(conversations: DataFrame, messages: DataFrame, leads: DataFrame) -> DataFrame:
    """Messages and leads of conversations, counted: ``conversation, status, messages, leads``."""
    n = lambda rows, name: rows.groupBy("conversation").agg(F.count("*").alias(name))
    both = conversations.join(n(messages, "messages"), "conversation").join(n(leads, "leads"), "conversation", "left")
    return both.select("conversation", "status", "messages", F.coalesce("leads", F.lit(0).cast("long")).alias("leads"))


def inbox_threads(conversations: DataFrame, messages: DataFrame, leads: DataFrame, most: int = 50) -> DataFrame:
    """Conversations with the rows of their last messages, and the newest lead of each (null: none)."""
    newest = leads.groupBy("conversation").agg(F.max("lead").alias("lead"))
    said = last_turns(messages, most).drop("workspace", "back")
    return conversations.drop("created_ms").join(said, "conversation").join(newest, "conversation", "left")


def escalate(requests: DataFrame, existing: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(escalations, conversations)`` after requests ``(conversation, seq, lead)``.

    The newest lead counts; one that was resolved is pending again, one that is
    open keeps its status; an active conversation becomes escalated.
    """
    asked = requests.groupBy("conversation").agg(F.max_by("lead", "seq").alias("__lead"))
    both = existing.join(asked, "conversation", "full")
    status = F.when(F.col("status").isNull() | ((F.col("status") == "resolved") & F.col("__lead").isNotNull()), "pending").otherwise(F.col("status"))
    rows = both.select("conversation", F.coalesce("__lead", "lead").alias("lead"), status.alias("status"), (F.col("status").isNotNull() & F.col("__lead").isNotNull()).alias("already_open"))
    hit = F.col("__lead").isNotNull() & (F.col("status") == "active")
    after = conversations.join(asked, "conversation", "left").withColumn("status", F.when(hit, "escalated").otherwise(F.col("status"))).drop("__lead")
    return rows, after


def escalation_notices(escalations: DataFrame, workspaces: DataFrame, leads: DataFrame) -> DataFrame:
    """Subject and contact of each escalation's notice; the lead may be missing, the workspace may not."""
    rows = escalations.join(workspaces.select("workspace", "name"), "workspace").join(leads.select("lead", "contact"), "lead", "left")
    return rows.select("conversation", "workspace", F.concat(F.lit("A visitor is waiting — "), F.col("name")).alias("subject"), F.coalesce("contact", F.lit("")).alias("contact"))
