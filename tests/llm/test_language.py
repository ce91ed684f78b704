"""Language ID against a plain naive Bayes, on held-out documents, and in its edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF

from quillspark.llm import language
from quillspark.llm.common import table

MASK = (1 << 64) - 1


def plain_buckets(text, bits):
    found, codes = [], [ord(c) for c in text.lower()]
    for n in range(1, language.LONGEST + 1):
        for i in range(len(codes) - n + 1):
            h = 0
            for k in range(n):
                h = ((h + k + 1) * 1_000_003 + codes[i + k]) & MASK
            found.append((h * 0x9E3779B97F4A7C15 & MASK) >> (64 - bits))
    return Counter(found)


def plain_model(rows, bits):
    counts, docs = defaultdict(Counter), Counter()
    for lang, text in rows:
        if lang is not None and text is not None:
            counts[lang] += plain_buckets(text, bits)
            docs[lang] += 1
    return counts, docs


def plain_predict(model, text, bits):
    counts, docs = model
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    scores = {}
    for lang in sorted(docs):
        total = sum(counts[lang].values()) + language.SMOOTHING * (1 << bits)
        scores[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((counts[lang][b] + language.SMOOTHING) / total) for b, n in plain_buckets(text, bits).items())
    best = max(scores, key=scores.get)
    return best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())


def test_scores_by_definition(spark, monkeypatch):
    monkeypatch.setattr(language, "WINDOW", 50)  # several windows a text
    rows = [(r["lang"], (r["text"] or "")[:300]) for r in sorted(table(spark, SF, "documents").limit(60).collect())]
    rows += [("en", None), (None, "xx yy"), ("", "zz qq zz"), ("fr", ""), ("fr", "été"), ("en", "the of"), ("en", "the of")]
    model = language.fit_languages(spark.createDataFrame(rows, "lang string, text string"), bits=12)
    want = plain_model(rows, 12)
    assert model.languages == sorted(want[1])
    for text in ["the and of", "été où", "a", "12 34", "", None, "zz", "Ünï \U0001f642", *(t for _, t in rows[:20])]:
        name, score = model.predict(text)
        assert (name, round(score, 3)) == (plain_predict(want, text, 12)[0], round(plain_predict(want, text, 12)[1], 3)), text


def test_windows_hold_every_ngram_once(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(997))
    whole = Counter(np.concatenate([*language.buckets(text, 16)]).tolist())
    for size in (1, 2, 3, 5, 64, 997, 2000):
        monkeypatch.setattr(language, "WINDOW", size)
        assert Counter(np.concatenate([*language.buckets(text, 16)]).tolist()) == whole == plain_buckets(text, 16)


def test_held_out_accuracy(spark):
    sf = SF
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in table(spark, sf, "documents").collect()}
    rows = language.op11_language(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held)
    assert held and right / len(held) >= 0.97


@pytest.mark.parametrize("rows", [[], [(None, "abc")], [("en", None)]], ids=["empty", "unlabelled", "null text"])
def test_nothing_learnt(spark, rows):
    model = language.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([(1, "abc", 5, "x"), (2, None, 5, "y")], "doc_id int, text string, language int, lang string")
    found = language.identify(docs, model, out_col="found").orderBy("doc_id").collect()
    if rows == [("en", None)]:
        assert model.languages == []
    assert [(r["found"]["lang_pred"], r["found"]["score"], r["language"], r["lang"]) for r in found] == [("und", 0.0, 5, "x"), ("und", 0.0, 5, "y")]
    assert language.identify(docs.limit(0), model).count() == 0


def test_many_languages_fit_the_matrix(spark):
    rows = [(f"l{i:04}", chr(0x4E00 + i) * 3) for i in range(600)]
    model = language.fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert model.matrix.size <= language.MATRIX_CELLS
    assert sum(model.predict(t)[0] == name for name, t in rows) > 590
