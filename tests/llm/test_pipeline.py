"""Stages of the pipeline, and the learnt operators' scores, against plain Python versions."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from test_operators import assert_packed, plain_components, segments_by_definition

import corpus_pipeline
from quillspark.llm import quality, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)


@pytest.fixture(scope="module")
def toxic(spark):
    return toxicity.trained_model(spark, SF)


@pytest.fixture(scope="module")
def good(spark):
    return quality.trained_model(spark, SF)


def plain_toxicity(model, text):
    scores = []
    for unit in text.split():
        word = re.sub(r"^\W+|\W+$", "", unit).lower()
        keys = [f"w{word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) > n)] if word else []
        buckets = [zlib.crc32(k.encode()) % 2**20 for k in keys]
        best = max(buckets, key=lambda b: model.weight[b], default=None)
        scores.append(float(model.value[best]) if best is not None and model.weight[best] >= 4.5 else -0.5)
    room = math.log(model.scale * max(1, len(scores)))
    evidence = sum(max(0.0, model.rate * s - room) for _, _, s in segments_by_definition(scores))
    a, b = model.curve
    return 1 / (1 + math.exp(-(a + b * math.log1p(evidence))))


def plain_grade(model, text):
    units = text.split()
    kind = lambda c: "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    bucket = lambda key: zlib.crc32(key.encode()) % 2**16
    forms = []
    for unit in units:
        runs = [(k, len([*run])) for k, run in itertools.groupby(unit, key=kind)]
        forms.append(bucket("s" + "".join(k if k in "Aa0" else k * n for k, n in runs)))
    words = [bucket("w" + u.lower()) for u in units]
    pairs = [(31 * a + 17 * b + 7) % 2**16 for a, b in itertools.pairwise(forms)]
    same = sum(a == b for a, b in itertools.pairwise(words))
    counts = Counter(words + forms + pairs + [bucket(f"again{10 * same // max(1, len(units))}")] * same)
    values = {b: math.log1p(n) for b, n in counts.items()}
    size = math.sqrt(sum(v * v for v in values.values())) or 1.0
    latent = sum(model.weights[b] * v / size for b, v in values.items())
    return 1 / (1 + math.exp(-(latent - model.thresholds[0])))


def short(rows, words):
    return {r["doc_id"]: r["text"] or "" for r in rows if len((r["text"] or "").split()) <= words}


def test_toxicity_scores_by_definition(spark, docs, toxic):
    texts = short(docs.collect(), 250)
    got = {r["doc_id"]: r["score"] for r in toxicity.op2_toxicity(spark, SF).collect()}
    assert len(texts) > 50
    assert {i: pytest.approx(plain_toxicity(toxic, t), abs=1e-9) for i, t in texts.items()} == {i: got[i] for i in texts}


def test_quality_scores_by_definition(spark, docs, good):
    texts = short(docs.collect(), 10**6)
    got = {r["doc_id"]: r["score"] for r in quality.op7_quality(spark, SF).collect()}
    assert {i: pytest.approx(plain_grade(good, t), abs=1e-5) for i, t in texts.items()} == {i: got[i] for i in texts}


def test_filters_keep_what_the_scores_say(spark, docs, good):
    more = "/root/testdata/sf0.01"
    some = spark.read.parquet(f"{more}/documents.parquet").select(*COLUMNS)
    rows = [r for r in some.collect() if len((r["text"] or "").split()) <= 200]
    model = toxicity.trained_model(spark, more)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows, docs.schema), more).collect()}
    assert kept == {r["doc_id"] for r in rows if plain_toxicity(model, r["text"] or "") < 0.7} and len(kept) < len(rows)
    rows = docs.collect()
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in rows if plain_grade(good, r["text"] or "") >= 0.5} and len(kept) < len(rows)


def test_boilerplate_by_brute_force(spark, docs):
    rows, pages, seen = docs.collect(), Counter(), defaultdict(Counter)
    key = lambda line: line.strip(" \t\r\f\v")
    for r in rows:
        pages[r["source"]] += 1
        seen[r["source"]].update({key(x) for x in (r["text"] or "").split("\n")} - {""})
    gone = {s: {x for x, n in c.items() if n >= 3 and n > 0.05 * pages[s]} for s, c in seen.items()}
    want = {r["doc_id"]: None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if key(x) not in gone[r["source"]]) for r in rows}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_boilerplate(spark, docs, SF).collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(t or "") for i, (t, n) in got.items() if t != next(r["text"] for r in rows if r["doc_id"] == i))


def test_near_copies_by_brute_force(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)})
    roots = plain_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[i]["doc_id"] for i in sorted(set(roots))]


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like those that stages use."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, row string, root long, lines string, site string, label int, __row string, toxicity string, quality int, lines_dropped string, row_hash long, ROW_HASH_ string, page string, gone int"
    clean = "The of and to in that is with for on. " * 8
    rows = [(1, clean), (1, clean), (1, "Another text with the same id, which is not alike at all."), (2, None), (None, None), (3, ""), (None, clean), (4, "word " * 30_000), (5, " \n\n\t")]
    mine = ("r", 1, "l", "s", 1, "q", "mine", 7, "own", 8, "kept", "p", 9)
    odd = spark.createDataFrame([(i, t, None, None, None, *mine) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.where("doc_id = -1"), SF).collect() == [], name
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns, name
        found = kept.collect()
        assert all(tuple(r)[5:] == mine and tuple(r)[2:4] == (None, None) for r in found), name
        texts = Counter((r["doc_id"], r["text"]) for r in found)
        given = Counter(rows)
        assert name == "line dedup" or not texts - given, name
        if name == "line dedup":
            assert sum(texts.values()) == len(rows)
        if name == "simhash near-dedup":
            # A kept group shows one row: the clean text, its namesake, the empty ones and the long one.
            assert texts == Counter([(1, clean), (1, rows[2][1]), (2, None), (4, rows[7][1])]), name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, odd.where("doc_id = -1"), SF).collect() == []
    packed = stage(spark, odd, SF).collect()
    assert_packed(packed)
    assert sum(r["piece"] == 0 for r in packed) == len(rows)


def test_whole_run(spark, docs):
    packed = corpus_pipeline.run(spark, SF).collect()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {r["doc_id"] for r in packed} == ids and 0 < len(ids) < docs.count()
    assert assert_packed(packed) <= np.ceil(sum(r["length"] for r in packed) / 4096) + 1
