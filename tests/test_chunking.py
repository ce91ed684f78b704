"""Chunks against a plain Python version, over every document."""

import math

import pytest
import regex
from conftest import SF

from quillspark.operators import chunking
from quillspark.plans import texts


def tokens(text):
    if not text.strip():
        return 0
    arabic = len(regex.findall(r"\p{Arabic}", text))
    other = len(text) - arabic - len(regex.findall(r"\p{White_Space}", text))
    return max(1, math.floor(arabic / 3.34 + other / 4.45 + 0.5))


def sentences(text):
    out, start = [], 0
    for i, c in enumerate(text):
        inside = c == "." and 0 < i < len(text) - 1 and text[i - 1].isdecimal() and text[i + 1].isdecimal()
        if c in "!?\n\u061f\u06d4" or (c == "." and not inside):
            out.append(text[start : i + 1].strip())
            start = i + 1
    return [s for s in [*out, text[start:].strip()] if s]


def packed(pieces, joint):
    groups, size = [], 0
    for piece in pieces:
        if not groups or size + tokens(piece) > 300:
            groups.append([])
            size = 0
        groups[-1].append(piece)
        size += tokens(piece)
    return [(joint.join(g), sum(map(tokens, g))) for g in groups]


def tail(text):
    kept, total = [], 0
    for s in reversed(sentences(text)):
        if kept and total + tokens(s) > 50:
            break
        kept, total = [s, *kept], total + tokens(s)
    return " ".join(kept)


def chunks(text):
    pieces = []
    for p in filter(None, (p.strip() for p in text.replace("\r\n", "\n").split("\n\n"))):
        pieces += [t for t, _ in packed(sentences(p), " ")] if tokens(p) > 450 else [p]
    found = packed(pieces, "\n\n")
    if len(found) > 1 and found[-1][1] < 40:
        both = f"{found[-2][0]}\n\n{found[-1][0]}"
        found[-2:] = [(both, tokens(both))]
    laid = [f"{tail(a)}\n\n{b}" for (a, _), (b, _) in zip(found, found[1:], strict=False)]
    return found[:1] + [(t, tokens(t)) for t in laid]


@pytest.mark.parametrize("name", ["chunk_text", "index_documents"])
def test_chunks_of_every_document(spark, name):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r["doc_id"], r["position"]): (r["text"], r["est_tokens"]) for r in texts.QUERIES[name](spark, SF).collect()}
    parted = (lambda t: t.replace("\n", "\n\n")) if name == "chunk_text" else (lambda t: t)
    assert got == {(i, n): c for i, t in docs.items() for n, c in enumerate(chunks(parted(t)))}


def test_odd_texts(spark):
    arabic = "هذا نص طويل عن المنتج. السعر 30.50 ريال؟ نعم! "
    odd = ["", " \n\n ", None, "one", arabic * 40, "word " * 700, "a. " * 900, (arabic + "\n\n") * 30, "x" * 300 + "\n\ny", ("p " * 290 + "\r\n\r\n") * 3 + "tail", "no stop " * 30 + "\n\n" + "é" * 1400]
    rows = chunking.chunk_documents(spark.createDataFrame(list(enumerate(odd)), "id int, text string"), "id", "text").collect()
    assert {(r["id"], r["position"]): (r["text"], r["est_tokens"]) for r in rows} == {(i, n): c for i, t in enumerate(odd) for n, c in enumerate(chunks(t or ""))}
