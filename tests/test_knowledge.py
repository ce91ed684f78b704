"""Stored tables: all or nothing, refresh, references, repeated commits, search; what failures leave behind."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_chunking import chunks as measured_chunks

from quillspark.functions.vector import hash_embedder
from quillspark.operators import knowledge
from quillspark.plans import knowledge as plans
from quillspark.plans.views import table
from quillspark.sources.commits import Conflict, Store
from quillspark.sources.shared import scratch_path

NOW = "2024-06-01T00:00:00Z"
REQUEST = "source string, workspace string, type string, title string, body string, pairs array<struct<question:string,answer:string>>, seq int"
LONG = "\n\n".join(f"Paragraph {i} " + "word " * 200 for i in range(6))


@pytest.fixture
def store(spark):
    return knowledge.open_store(spark, scratch_path(spark, "knowledge"))


def plain_chunks(text):
    return [t for t, _ in measured_chunks(text)]


def plain_store(spark):
    return Store(spark, scratch_path(spark, "store"), {"a": "k string, v int", "b": "k string, v int"}, {"a": ["k"]})


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, *values):
    return spark.createDataFrame(list(values), "k string, v int")


def breaks(column):
    """A column whose evaluation kills the task."""
    return F.when(F.length(column) >= 0, F.raise_error(F.lit("no such luck"))).otherwise(F.array().cast("array<float>"))


# --- commits


def test_reads_follow_versions(spark):
    store = plain_store(spark)
    assert store.read("a").count() == 0 and store.version() == 0
    one = store.commit({"a": frame(spark, ("x", 1), ("y", 2)), "b": frame(spark, ("x", 1))})
    two = store.commit(*store.replace("a", ["k"], frame(spark, ("x", 5))))
    three = store.commit(gone={"a": [spark.createDataFrame([("y",)], "k string")], "b": [spark.createDataFrame([(1,)], "v int")]})
    assert [rows(store.read("a", n)) for n in (one, two, three)] == [[("x", 1), ("y", 2)], [("x", 5), ("y", 2)], [("x", 5)]]
    assert rows(store.read("b")) == [] and rows(store.read("b", two)) == [("x", 1)]
    store.commit({"a": frame(spark, ("y", 9))})  # a deletion holds for earlier rows only
    assert rows(store.read("a")) == [("x", 5), ("y", 9)]
    store.compact("a")
    assert rows(store.read("a")) == [("x", 5), ("y", 9)] and rows(store.read("a", two)) == [("x", 5), ("y", 2)]
    store.commit(gone={"a": [spark.createDataFrame([("x",)], "k string")]})
    assert rows(store.read("a")) == [("y", 9)]


def test_a_job_killed_between_tables_changes_nothing(spark):
    store = plain_store(spark)
    store.commit({"a": frame(spark, ("x", 1)), "b": frame(spark, ("x", 1))})
    bad = frame(spark, ("z", 3)).withColumn("v", F.when(F.col("v") > 0, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        store.commit({"a": frame(spark, ("y", 2)), "b": bad}, {"a": [spark.createDataFrame([("x",)], "k string")]})
    assert rows(store.read("a")) == [("x", 1)] and rows(store.read("b")) == [("x", 1)] and store.version() == 1


def test_a_writer_killed_while_publishing_is_never_read(spark):
    store = plain_store(spark)
    store.commit({"a": frame(spark, ("x", 1))})
    fs, path = store._path(f"_commits/{2:012d}")
    out = fs.create(path, False)
    out.write(bytearray(b'{"tag": null, "tab'))
    out.close()
    assert rows(store.read("a")) == [("x", 1)] and store.version() == 1
    assert store.commit({"a": frame(spark, ("y", 2))}) == 3
    assert rows(store.read("a")) == [("x", 1), ("y", 2)]


def test_conflicts_and_repeats(spark):
    store = plain_store(spark)
    seen = store.version()
    store.commit({"a": frame(spark, ("x", 1))}, tag="batch-1")
    with pytest.raises(Conflict):
        store.commit({"a": frame(spark, ("y", 1))}, expect=seen)
    store.commit({"a": frame(spark, ("x", 1))}, tag="batch-1")
    assert rows(store.read("a")) == [("x", 1)]


# --- ingest


def test_ingest_states(spark, store):
    requests = spark.createDataFrame(
        [
            ("s1", "w1", "text", "One", LONG, None, 1), ("s2", "w1", "faq", "Two", None, [("Q?", "A."), ("", " "), (None, "B.")], 2), ("s3", "w1", "text", "Three", LONG, None, 3),
            ("s4", "w1", "faq", "Four", None, [("Q?", "A.")], 4), ("s5", "w2", "text", "Five", "  \n ", None, 5), ("s6", "w2", "pdf", "Six", "x", None, 6), ("s7", "", "text", "Seven", "x", None, 7), ("s8", "w2", "html", "Eight", "x", None, 8),
            ("s9", "w3", "text", "Nine", "Short text.", None, 9),
        ],
        REQUEST,
    )
    limits = spark.createDataFrame([("w1", 12), ("w2", 0)], "workspace string, chunk_limit int")
    n = len(plain_chunks(LONG))
    assert 4 < n < 10
    refused = {r["source"]: r["error"] for r in knowledge.ingest(store, requests, limits, NOW).collect()}
    assert refused == {"s5": "source has no usable content", "s6": 'source type "pdf" is not implemented yet', "s7": "workspace is required", "s8": 'unknown source type "html"'}
    got = {r["source"]: (r["status"], r["error"], r["pages"], r["last_refreshed"] is not None) for r in store.read("sources").collect()}
    full = f"workspace chunk limit reached: {n} chunks would exceed the plan limit of 12 (currently {n + 2})"
    assert got == {"s1": ("ready", "", n, True), "s2": ("ready", "", 2, True), "s3": ("failed", full, 0, False), "s4": ("ready", "", 1, True), "s9": ("ready", "", 1, True)}
    chunks = store.read("chunks").collect()
    assert sorted((r["source"], r["position"], r["text"]) for r in chunks if r["source"] == "s1") == [("s1", i, t) for i, t in enumerate(plain_chunks(LONG))]
    assert [r["text"] for r in sorted((r for r in chunks if r["source"] == "s2"), key=lambda r: r["position"])] == ["Q?\nA.", "B."]
    assert {r["source"] for r in chunks} == {"s1", "s2", "s4", "s9"} and all(len(r["embedding"]) == 1024 for r in chunks)


def test_ingest_that_dies_leaves_a_failed_source(spark, store):
    requests = spark.createDataFrame([("s1", "w1", "text", "One", "Some text.", None, 1)], REQUEST)
    limits = spark.createDataFrame([("w1", 0)], "workspace string, chunk_limit int")
    with pytest.raises(Exception, match="no such luck"):
        knowledge.ingest(store, requests, limits, NOW, breaks)
    source = store.read("sources").first()
    assert (source["status"], source["pages"]) == ("failed", 0) and source["error"].startswith("could not build the search index")
    assert store.read("chunks").count() == 0


def fnv_vector(text, dims=1024):
    v = np.zeros(dims, dtype=np.float32)
    for word in text.lower().split():
        h = 0x811C9DC5
        for byte in word.encode():
            h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
        v[h % dims] += 1
    size = np.sqrt((v.astype(np.float64) ** 2).sum())
    return v / np.float32(size) if size else v


def test_all_documents_as_stored(spark):
    """Chunks, positions, normal forms and vectors of the whole table."""
    docs = {f"doc-{r['doc_id']}": r["text"] for r in table(spark, SF, "documents").collect()}
    want = {(f"{name}-{i}", name, i, t) for name, text in docs.items() for i, t in enumerate(plain_chunks(text or ""))}
    got = plans.ingest_texts(spark, SF).collect()
    assert {(r["chunk"], r["source"], r["position"], r["text"]) for r in got} == want and len(got) == len(want)
    for r in got:
        assert np.allclose(r["embedding"], fnv_vector(r["text"]), atol=1e-6)


# --- refresh


def site(spark, *pages):
    docs = spark.createDataFrame([(s, i, f"https://{s}/{i}", title, text) for s, i, title, text in pages], "source string, place int, url string, title string, text string")
    skipped = spark.createDataFrame([("s1", 9, "https://s1/9", "HTTP 404")], "source string, place int, url string, reason string")
    return docs, skipped


def test_refresh(spark, store):
    knowledge.add_websites(store, spark.createDataFrame([("s1", "w1", "One", "https://s1"), ("s2", "w1", "Two", "https://s2"), ("s3", "w1", "Three", "")], "source string, workspace string, title string, url string"), NOW)
    knowledge.ingest(store, spark.createDataFrame([("t1", "w1", "text", "T", "Own text.", None, 1)], REQUEST), spark.createDataFrame([("w1", 0)], "workspace string, chunk_limit int"), NOW)
    limits = spark.createDataFrame([("w1", 5)], "workspace string, chunk_limit int")
    targets = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3), ("t1", 4), ("gone", 5)], "source string, seq int")
    docs, skipped = site(spark, ("s1", 1, "First", "One page."), ("s1", 2, "", "Another page."), ("s2", 1, "Blank", "   "))
    refused = {r["source"]: r["error"] for r in knowledge.refresh(store, targets, docs, skipped, limits, NOW).collect()}
    assert refused == {"s3": "source has no URL", "t1": "only website sources can be refreshed", "gone": "source not found"}
    state = lambda: {r["source"]: (r["status"], r["error"], r["pages"]) for r in store.read("sources").collect()}
    texts = lambda: sorted((r["source"], r["position"], r["text"]) for r in store.read("chunks").collect())
    left_out = "1 page(s) were not indexed: https://s1/9 (HTTP 404)"
    assert state() == {"s1": ("ready", left_out, 2), "s2": ("failed", "the pages we could read contained no usable text", 0), "s3": ("queued", "", 0), "t1": ("ready", "", 1)}
    once = [("s1", 0, "First\n\nOne page."), ("s1", 1, "Another page."), ("t1", 0, "Own text.")]
    assert texts() == once
    knowledge.refresh(store, targets, docs, skipped, limits, NOW)
    assert texts() == once and state()["s1"] == ("ready", left_out, 2)
    many, _ = site(spark, *(("s1", i, "T", f"Page {i}.") for i in range(6)))
    knowledge.refresh(store, targets.where("source = 's1'"), many, skipped, limits, NOW)
    assert state()["s1"] == ("failed", "workspace chunk limit reached: this site produced 6 passages, which would exceed the plan limit of 5", 0)
    assert texts() == [("t1", 0, "Own text.")]
    knowledge.refresh(store, targets.where("source = 's1'"), docs.limit(0), skipped.limit(0), limits, NOW)
    assert state()["s1"] == ("failed", "we could not read any pages from this address", 0)
    knowledge.refresh(store, targets.where("source = 's1'"), docs.limit(0), skipped, limits, NOW)
    assert state()["s1"] == ("failed", f"no pages could be indexed. {left_out}", 0)


def test_refresh_that_dies_half_way_leaves_no_stale_text(spark, store):
    knowledge.add_websites(store, spark.createDataFrame([("s1", "w1", "One", "https://s1")], "source string, workspace string, title string, url string"), NOW)
    docs, skipped = site(spark, ("s1", 1, "First", "One page."))
    limits, targets = spark.createDataFrame([("w1", 0)], "workspace string, chunk_limit int"), spark.createDataFrame([("s1", 1)], "source string, seq int")
    knowledge.refresh(store, targets, docs, skipped, limits, NOW)
    assert store.read("chunks").count() == 1
    with pytest.raises(Exception, match="no such luck"):
        knowledge.refresh(store, targets, docs, skipped, limits, NOW, breaks)
    assert store.read("chunks").count() == 0
    assert store.read("sources").first()["status"] == "failed"


def test_all_sites_as_stored(spark):
    docs, skipped = plans._site_pages(spark, SF)
    want = {}
    for r in sorted(docs.collect(), key=lambda r: r["place"]):
        n, pages = want.get(r["source"], (0, 0))
        want[r["source"]] = (n + len(plain_chunks(r["text"])), pages + 1)
    got = {r["source"]: r for r in plans.refresh_sites(spark, SF).collect()}
    for name, (n, pages) in want.items():
        assert (got[name]["status"], got[name]["pages"], got[name]["chunks"], got[name]["last_position"]) == ("ready", pages, n, n - 1)
    assert all(r["status"] == "failed" for name, r in got.items() if name not in want)


# --- deletion and search


def test_deletion_leaves_no_orphans(spark):
    store = plans._filled(spark, SF)
    known = lambda: {name: df.count() for name, df in knowledge.orphans(store).items()}
    before = known()
    knowledge.delete_records(store, "workspaces", spark.createDataFrame([("3",), ("4",)], "workspace string"))
    knowledge.delete_records(store, "conversations", spark.createDataFrame([("5",), ("13",)], "conversation string"))
    knowledge.delete_records(store, "sources", spark.createDataFrame([("1",)], "source string"))
    after = known()
    assert all(after[name] <= before[name] for name in before)
    assert {after[name] for name in ("memberships", "messages", "leads", "escalations", "conversations", "knowledge_gaps", "sources")} == {0}
    for name in ("messages", "leads", "escalations"):
        assert store.read(name).where("conversation in ('5', '13') or workspace in ('3', '4')").count() == 0
    assert store.read("chunks").where("source = '1' or workspace in ('3', '4')").count() == 0


def test_the_last_workspace_stays(spark, store):
    knowledge.sign_up(store, spark.createDataFrame([("u1", "Ann", "ann@x.org"), ("u2", "", "bob@x.org")], "user string, name string, email string"), NOW)
    workspaces = rows(store.read("workspaces").select("workspace"))
    with pytest.raises(ValueError, match="at least one workspace"):
        knowledge.delete_records(store, "workspaces", spark.createDataFrame(workspaces[:1], "workspace string"))
    assert rows(store.read("workspaces").select("workspace")) == workspaces
    extra = store.read("workspaces").limit(1).withColumn("workspace", F.lit("w-extra"))
    store.commit({"workspaces": extra})
    knowledge.delete_records(store, "workspaces", spark.createDataFrame([("w-extra",)], "workspace string"))
    assert rows(store.read("workspaces").select("workspace")) == workspaces
    assert rows(knowledge.orphans(store)["memberships"]) == []


def test_search_reads_one_tenant(spark, store):
    texts = [(f"c{i}", f"w{i % 3}", f"s{i % 5}", f"word{i % 7} word{i % 11} text {i}") for i in range(60)]
    chunks = spark.createDataFrame(texts, "chunk string, workspace string, source string, text string").withColumn("embedding", hash_embedder(64)(F.col("text")))
    store.commit({"chunks": plans._loaded(spark, "chunks", chunks)})
    query = [float(x) for x in fnv_vector("word1 word2 text", 64)]

    def brute(alive):
        far = [(round(float(np.sqrt(((fnv_vector(t, 64).astype(np.float64) - np.array(query)) ** 2).sum())), 6), c) for c, w, s, t in texts if w == "w1" and alive(s)]
        return [c for _, c in sorted(far)[:8]]

    found = lambda: [r["chunk_id"] for r in knowledge.search(store, "w1", query).collect()]
    assert found() == brute(lambda s: True)
    knowledge.delete_records(store, "sources", spark.createDataFrame([("s1",), ("s2",)], "source string"))
    assert found() == brute(lambda s: s not in ("s1", "s2"))
    store.compact("chunks")
    assert found() == brute(lambda s: s not in ("s1", "s2"))
    plan = knowledge.search(store, "w1", query)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace" in plan and "= w1)" in plan
    with pytest.raises(ValueError):
        knowledge.search(store, "", query)
