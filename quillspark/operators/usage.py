"""Usage metering by account and UTC month, the spending cap, and knowledge gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_arabic

# Fixed value: price of a reply beyond the plan's.
OVERAGE_USD = 0.02


def period(ts: Column) -> Column:
    """UTC month of a time, whatever the session's time zone; times without a zone are UTC."""
    return F.substring(F.to_utc_timestamp(ts, F.current_timezone()).cast("string"), 1, 7)


def monthly_usage(replies: DataFrame) -> DataFrame:
    """Replies and overage of each account and month; ``overage`` marks replies beyond the plan."""
    return replies.groupBy("account", period(F.col("ts")).alias("period")).agg(F.count("*").alias("replies"), F.sum(F.when(F.col("overage"), OVERAGE_USD).otherwise(0.0)).alias("overage_usd"))


def verdict(used: Column, limit: Column, spent: Column, cap: Column) -> Column:
    """``allow`` within the plan, ``overage`` within the cap, else ``deny``; a cap of zero never bills."""
    return F.when(used < limit, "allow").when(cap <= 0, "deny").when(spent + F.lit(OVERAGE_USD) > cap, "deny").otherwise("overage")


def running_overage(replies: DataFrame, order_col: str) -> DataFrame:
    """Verdict of every reply in order, from ``account, period, limit, cap``.

    The spend so far is a running sum of the same additions, so it equals step-by-step metering.
    By its meaning an account's month is summed in order, by one task.
    """
    w = f"(PARTITION BY account, period ORDER BY {order_col}"
    numbered = replies.withColumn("n", F.expr(f"row_number() OVER {w})"))
    over = F.when(F.col("n") > F.col("limit"), F.lit(OVERAGE_USD)).otherwise(F.lit(0.0))
    spent = numbered.withColumn("__over", over).withColumn("spent", F.expr(f"coalesce(sum(__over) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0D)"))
    return spent.withColumn("verdict", verdict(F.col("n") - 1, F.col("limit"), F.col("spent"), F.col("cap"))).drop("__over")


def overage_cost(replies: Column) -> Column:
    return F.when(replies <= 0, 0.0).otherwise(F.round(replies * F.lit(OVERAGE_USD), 2))


def replies_under_cap(spent: Column, cap: Column) -> Column:
    return F.when(cap - spent <= 0, 0).otherwise(F.floor((cap - spent) / F.lit(OVERAGE_USD))).cast("long")


def gap_fold(questions: DataFrame, order_col: str) -> DataFrame:
    """Unanswered questions by workspace and normal form: how often, how near the best miss, as first asked."""
    rows = questions.withColumn("question_normalized", normalize_arabic(F.col("question")))
    return rows.groupBy("workspace", "question_normalized").agg(
        F.count("*").alias("n"), F.max("similarity").alias("best_similarity"), F.min_by("question", order_col).alias("question"), F.min_by("language", order_col).alias("language")
    )


def near_misses(gaps: DataFrame, least: float = 0.25) -> DataFrame:
    return gaps.where(F.col("best_similarity") >= least)


def escalation_fold(requests: DataFrame) -> DataFrame:
    """One escalation per conversation: the newest lead, whether it was asked for again, open again if resolved before."""
    return requests.groupBy("conversation").agg(F.max_by("lead", "seq").alias("lead"), F.count("*").alias("requests"), (F.count("*") > 1).alias("already_open"), F.lit("pending").alias("status"))


def billing_summary(accounts: DataFrame, usage: DataFrame, limits: DataFrame, month: str) -> DataFrame:
    """Accounts with their plan's allowance and the month's use, nothing used where there is no row."""
    now = usage.where(F.col("period") == month).select("account", F.col("replies").alias("used"), F.col("overage_usd").alias("overage"))
    rows = accounts.join(now, "account", "left").join(limits, "plan", "left")
    return rows.select("account", "plan", F.coalesce("used", F.lit(0).cast("long")).alias("used"), "allowance", F.coalesce("overage", F.lit(0.0)).alias("overage_usd"), (F.coalesce("stripe_customer_id", F.lit("")) != "").alias("has_customer"))


def set_caps(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Accounts after their owners' last valid cap ``(account, seq, cap)``; a negative cap changes nothing, zero never bills."""
    last = requests.where("cap >= 0").groupBy("account").agg(F.max_by("cap", "seq").alias("__cap"))
    return accounts.join(last, "account", "left").withColumn("hard_cap_usd", F.coalesce("__cap", "hard_cap_usd")).drop("__cap")


# Fixed value: months charged for a year.
MONTHS_CHARGED = 10


def annual_monthly(monthly: Column) -> Column:
    return F.round(monthly * MONTHS_CHARGED / 12, 2)


def annual_total(monthly: Column) -> Column:
    return monthly * MONTHS_CHARGED


def source_pages(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources with ``pages``: how many pages a website has in the index, or how many chunks any other source has."""
    n = chunks.groupBy("source").agg(F.count("*").alias("__chunks"), F.countDistinct("page").alias("__pages"))
    count = F.when(F.col("type") == "website", F.col("__pages")).otherwise(F.col("__chunks"))
    return sources.join(n, "source", "left").withColumn("pages", F.coalesce(count, F.lit(0).cast("long"))).drop("__chunks", "__pages")


def answer_gaps(gaps: DataFrame, answers: DataFrame, room: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(question-answer sources, gaps)`` after answers ``(gap, answer)``; ``room(workspace, left)`` is for one chunk each.

    A gap counts as answered only where its source was taken in.
    """
    asked = answers.where("coalesce(answer, '') != ''").groupBy("gap").agg(F.min("answer").alias("answer"))
    place = F.expr("row_number() OVER (PARTITION BY workspace ORDER BY gap)")
    tried = gaps.join(asked, "gap").join(room, "workspace", "left").withColumn("__fits", F.col("left").isNull() | (place <= F.col("left")))
    sources = tried.select("gap", "workspace", F.col("question").alias("title"), F.lit("faq").alias("type"), F.concat_ws("\n", "question", "answer").alias("text"), F.when(F.col("__fits"), "ready").otherwise("failed").alias("status"))
    done = sources.where("status = 'ready'").select("gap", F.lit(True).alias("__done"))
    after = gaps.join(done, "gap", "left").withColumn("answered", F.col("answered") | F.coalesce("__done", F.lit(False))).drop("__done")
    return sources, after
