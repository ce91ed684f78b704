"""Event sources: signatures as a table of cases, frames and deliveries as streams that restart."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import billing
from quillspark.sources import frames
from quillspark.sources.shared import scratch_path

SECRET, NOW = "whsec_test", 1_700_000_000
BODY = '{"id": "evt_1",  "type": "ping"}'


def signed(body, at=NOW, secret=SECRET):
    return hmac.new(secret.encode(), f"{at}.{body}".encode(), hashlib.sha256).hexdigest()


CASES = [
    ("genuine", BODY, f"t={NOW},v1={signed(BODY)}", True), ("beside others", BODY, f"t={NOW},v1=00,v0=x,v1={signed(BODY)}", True), ("spaces", BODY, f" t={NOW} , v1={signed(BODY)}", True),
    ("tampered", BODY.replace("ping", "pong"), f"t={NOW},v1={signed(BODY)}", False), ("encoded anew", json.dumps(json.loads(BODY)), f"t={NOW},v1={signed(BODY)}", False), ("wrong secret", BODY, f"t={NOW},v1={signed(BODY, secret='whsec_other')}", False),
    ("a day old", BODY, f"t={NOW - 86400},v1={signed(BODY, NOW - 86400)}", False), ("at the limit", BODY, f"t={NOW - 300},v1={signed(BODY, NOW - 300)}", True), ("past it", BODY, f"t={NOW - 301},v1={signed(BODY, NOW - 301)}", False),
    ("no header", BODY, "", False), ("null header", BODY, None, False), ("garbage", BODY, "garbage", False), ("no time", BODY, f"v1={signed(BODY)}", False), ("old scheme", BODY, f"t={NOW},v0={signed(BODY)}", False), ("time is no number", BODY, f"t=x,v1={signed(BODY)}", False),
    ("another time", BODY, f"t={NOW - 1},v1={signed(BODY)}", False), ("null body", None, f"t={NOW},v1={signed('')}", True), ("not Latin", BODY, f"t={NOW},v1=é", False),
]


def test_signatures(spark):
    rows = spark.createDataFrame([(n, b, h) for n, b, h, _ in CASES], "name string, body string, header string")
    check = lambda secret, now: {r["name"]: r["ok"] for r in rows.select("name", billing.signature_valid(F.col("body"), F.col("header"), secret, now).alias("ok")).collect()}
    assert check(SECRET, NOW) == {n: ok for n, _, _, ok in CASES}
    assert not any(check("", NOW).values())
    assert check(SECRET, None)["a day old"]


def take(stream, state, found):
    q = stream.writeStream.foreachBatch(lambda df, n: found.extend(map(tuple, df.collect())) and None).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def test_frames_stream_and_restart(spark):
    path, state, found = scratch_path(spark, "frames"), scratch_path(spark, "state"), []
    payload = "id int, text string"
    for first in (0, 3):
        rows = spark.createDataFrame([(f"e{i % 2}", i, f"line\n\nno {i} \"quoted\" é") for i in range(first, first + 3)], "event string, id int, text string")
        frames.write_frames(rows.select("event", F.struct("id", "text").alias("payload")), path, "event", "payload")
        take(frames.read_frames(spark, path, payload, stream=True).select("event", "payload.*"), state, found)
    take(frames.read_frames(spark, path, payload, stream=True).select("event", "payload.*"), state, found)
    assert sorted(found, key=lambda r: r[1]) == [(f"e{i % 2}", i, f"line\n\nno {i} \"quoted\" é") for i in range(6)]
    spark.createDataFrame([(": heartbeat",), ("event: e9",), ("data: {\"id\": 9}",)], "value string").coalesce(1).write.mode("append").option("lineSep", "\n\n").text(path)
    rows = frames.read_frames(spark, path, payload).collect()
    assert len(rows) == 7 and [r["payload"]["id"] for r in rows if r["event"] == ""] == [9]


def test_deliveries_stream_and_restart(spark):
    path, state, found = scratch_path(spark, "deliveries"), scratch_path(spark, "state"), []
    for part in (CASES[:5], CASES[5:]):
        spark.createDataFrame([(b, h, NOW) for _, b, h, _ in part], "body string, signature string, received long").write.mode("append").json(path)
        take(frames.read_deliveries(spark, path, SECRET, stream=True).select("body", "signature", "valid"), state, found)
    assert sorted(found, key=repr) == sorted([(b, h, ok) for _, b, h, ok in CASES], key=repr)


@pytest.mark.parametrize("of,shape", [(frames.new_widget_key, frames.is_widget_key), (frames.new_invite, frames.is_invite)])
def test_new_keys(spark, of, shape):
    keys = [r[0] for r in spark.range(500).select(of("id").alias("k")).collect()]
    assert len(set(keys)) == 500
    assert spark.createDataFrame([(k,) for k in keys], "k string").where(shape(F.col("k"))).count() == 500
