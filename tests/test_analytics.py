"""Medians by counting, against the built-in one; windows and days."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.operators import analytics


def test_medians_of_ties_and_hot_keys(spark):
    rng = random.Random(6)
    rows = [("hot", rng.choice([5, 5, 5, 7, rng.randint(-50, 50)])) for _ in range(6000)]
    rows += [(f"k{i}", rng.randint(0, 10**12)) for i in range(40) for _ in range(rng.randint(1, 9))]
    rows += [("one", 3), ("two", 3), ("two", 4), ("none", None), (None, 8), (None, 9), ("wide", -(2**52)), ("wide", 2**52)]
    df = spark.createDataFrame(rows, "key string, value long").repartition(7)
    got = {r["key"]: r["median"] for r in analytics.exact_medians(df, "key", "value").collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert {k: m for k, m in got.items() if k is not None} == {k: statistics.median(v) for k, v in by.items() if k is not None}
    built_in = {r["key"]: r["m"] for r in df.where("value is not null and key is not null").groupBy("key").agg(F.percentile("value", F.lit(0.5)).alias("m")).collect()}
    assert {k: got[k] for k in built_in} == built_in
    assert analytics.exact_medians(df.limit(0), "key", "value").count() == 0


def test_a_summary_scans_messages_once(spark):
    kind = "workspace int, conversation int, turn int, role string, outcome string, rating string, created_ms long"
    messages = spark.createDataFrame([(1, 1, 0, "user", "", "", 5), (1, 1, 1, "assistant", "answered", "up", 9), (1, 2, 0, "user", "", "", 1), (2, 3, 0, "assistant", "refused", "", 3)], kind)
    got = {r["workspace"]: (r["answered"], r["unanswered"], r["up"], r["down"], r["median_ms"]) for r in analytics.message_figures(messages).collect()}
    assert got == {1: (1, 0, 1, 0, 4), 2: (0, 1, 0, 0, None)}


@pytest.mark.parametrize("given,days", [(1, 1), (365, 365), (0, 30), (366, 30), (-5, 30), ("7", 7), ("x", 30), (None, 30), ("", 30), (2.5, 2)])
def test_days(given, days):
    assert analytics.days_or_default(given) == days


def test_month_starts_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Riyadh")
    try:
        now = 1706745600000 - 1  # the last millisecond of January 2024, UTC
        assert [r[0] for r in spark.range(1).select(analytics.month_start_ms(now)).collect()] == [1704067200000]
        assert [r[0] for r in spark.range(1).select(analytics.month_start_ms(now + 1)).collect()] == [1706745600000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
