"""Streams into stored tables, delivered twice and restarted; streaming state that is let go."""

import datetime
import json

from pyspark.sql import functions as F

from quillspark.operators import knowledge
from quillspark.sources.shared import scratch_path
from quillspark.streaming import live, stored


def new_store(spark):
    return knowledge.open_store(spark, scratch_path(spark, "stored"))


def at(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


REPLY = "account string, ts timestamp, overage boolean"


def usage_of(store):
    return {(r["account"], r["period"]): (r["ai_replies_used"], round(r["overage_usd"], 6)) for r in store.read("usage").collect()}


def test_a_batch_delivered_twice_counts_once(spark):
    store, keys = new_store(spark), ["account", "period"]
    first = stored.with_period(spark.createDataFrame([("a", at(0), False), ("a", at(1), True), ("b", at(40), True)], REPLY))
    second = stored.with_period(spark.createDataFrame([("a", at(2), True)], REPLY))
    for rows, tag in [(first, "usage:0"), (first, "usage:0"), (second, "usage:1"), (first, "usage:0"), (second, "usage:1")]:
        stored.merge(store, "usage", keys, stored.fold_usage, rows, tag)
    assert usage_of(store) == {("a", "2024-01"): (3, 0.04), ("b", "2024-02"): (1, 0.02)}
    store.compact("usage")
    stored.merge(store, "usage", keys, stored.fold_usage, second, "usage:1")
    assert usage_of(store)[("a", "2024-01")] == (3, 0.04)


def test_a_restarted_stream_goes_on(spark):
    store, source, state = new_store(spark), scratch_path(spark, "replies"), scratch_path(spark, "state")
    want = {}
    for day in (0, 1, 35):
        spark.createDataFrame([("a", at(day), day % 2 == 1)], REPLY).coalesce(1).write.mode("append").parquet(source)
        stream = stored.with_period(spark.readStream.schema(REPLY).parquet(source))
        stored.keep(stream, store, "usage", ["account", "period"], stored.fold_usage, "usage", state).awaitTermination()
        key = ("a", at(day).strftime("%Y-%m"))
        n, usd = want.get(key, (0, 0.0))
        want[key] = (n + 1, round(usd + 0.02 * (day % 2 == 1), 6))
        assert usage_of(store) == want


def test_gaps(spark):
    store, keys = new_store(spark), ["workspace", "question_normalized"]
    kind = "workspace string, question string, language string, similarity double, seq int, at timestamp"
    batch = lambda *rows: stored.with_normal_form(spark.createDataFrame(list(rows), kind))
    stored.merge(store, "knowledge_gaps", keys, stored.fold_gaps, batch(("w", "How  much?", "en", 0.1, 2, at(1)), ("w", "How much?", "ar", 0.3, 1, at(0)), ("w", "  ", "en", 0.9, 3, at(0))), "g:0")
    answered = store.read("knowledge_gaps").withColumn("answered", F.lit(True))
    store.commit(*store.replace("knowledge_gaps", keys, answered))
    stored.merge(store, "knowledge_gaps", keys, stored.fold_gaps, batch(("w", "How much?", "en", 0.2, 4, at(5)), ("v", "How much?", "en", 0.2, 5, at(6))), "g:1")
    got = {r["workspace"]: (r["question"], r["language"], r["count"], r["best_similarity"], r["answered"], r["created"], r["updated"]) for r in store.read("knowledge_gaps").collect()}
    assert got == {"w": ("How much?", "ar", 3, 0.3, True, at(0), at(5)), "v": ("How much?", "en", 1, 0.2, False, at(6), at(6))}


def test_escalations(spark):
    store = new_store(spark)
    kind = "conversation string, workspace string, lead string, seq int, at timestamp"
    put = lambda rows, tag: stored.merge(store, "escalations", ["conversation"], stored.fold_escalations, spark.createDataFrame(rows, kind), tag)
    put([("c1", "w", "l1", 1, at(0)), ("c1", "w", "l2", 2, at(1)), ("c2", "w", "l3", 3, at(1))], "e:0")
    for name, status in (("c1", "assigned"), ("c2", "resolved")):
        row = store.read("escalations").where(F.col("conversation") == name).withColumn("status", F.lit(status))
        store.commit(*store.replace("escalations", ["conversation"], row))
    put([("c1", "w", "l4", 4, at(2)), ("c2", "w", None, 5, at(3))], "e:1")
    got = {r["conversation"]: (r["lead"], r["status"], r["created"], r["updated"]) for r in store.read("escalations").collect()}
    assert got == {"c1": ("l4", "assigned", at(0), at(2)), "c2": ("l3", "pending", at(1), at(3))}


def test_ledger_keeps_the_first_delivery(spark):
    store = new_store(spark)
    kind = "event_id string, type string, account string, result string, seq int, at timestamp"
    put = lambda rows, tag: stored.merge(store, "billing_events", ["event_id"], stored.fold_ledger, spark.createDataFrame(rows, kind), tag)
    put([("e1", "b", "", "", 2, at(1)), ("e1", "a", "", "", 1, at(0))], "l:0")
    put([("e1", "c", "", "", 3, at(500)), ("e2", "d", "", "", 4, at(500))], "l:1")
    assert sorted((r["event_id"], r["type"]) for r in store.read("billing_events").collect()) == [("e1", "a"), ("e2", "d")]


def run(spark, stream_of, kind, batches, mode):
    """Rows put out, and how many rows the state had after every batch."""
    source, out = scratch_path(spark, "source"), scratch_path(spark, "out")
    sizes, found = [], []
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = stream_of(spark.readStream.schema(kind).parquet(source))
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: found.extend(map(tuple, df.collect())) and None).option("checkpointLocation", out).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append([sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in q.recentProgress][-1])
    return found, sizes


def test_closed_months_leave_the_state(spark):
    batches = [[(f"a{i}", at(31 * month), False) for i in range(20)] for month in range(5)] + [[("late", at(0), False), ("a0", at(31 * 4), True)]]
    found, sizes = run(spark, live.usage_stream, REPLY, batches, "append")
    assert max(sizes) <= 60 and sizes[-1] < 60
    assert not any(r[0] == "late" for r in found)
    closed = {r[1] for r in found}
    assert {"2024-01", "2024-02"} <= closed and len(found) == 20 * len(closed) and all(r[2] == 1 for r in found)


def test_replayed_ids_leave_the_state(spark):
    history = spark.createDataFrame([(1,), (2,)], "id int")
    kind = "id int, ts timestamp"
    minute = lambda m: at(0) + datetime.timedelta(minutes=m)
    batches = [[(i, minute(0)) for i in range(30)] + [(5, minute(1))], [(5, minute(2)), (100, minute(30))], [(101, minute(60))], [(102, minute(90))]]
    found, sizes = run(spark, lambda s: live.not_replayed(s, history), kind, batches, "append")
    assert sorted(r[0] for r in found) == [0, *range(3, 30), 100, 101, 102]
    assert sizes[0] >= 28 and sizes[-1] <= 3
