"""Texts of a batch are worked on, and leave, a few at a time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions.batches import BYTES, ROWS, pieces
from quillspark.functions.html import read_html
from quillspark.functions.text import collapse_space, normalize_arabic, split_sentences, trim_space
from quillspark.functions.vector import _hashes, hash_embedder


def test_pieces_cover_a_batch_in_order():
    texts = pa.array(["x" * n if n % 7 else None for n in range(3 * ROWS)] + ["y" * BYTES, "", "z" * (3 * BYTES), "é"])
    cut = [*pieces(texts)]
    assert [i for s in cut for i in range(s.start, s.stop)] == [*range(len(texts))]
    assert all(s.stop - s.start <= ROWS for s in cut)
    assert all(sum(len((t or "").encode()) for t in texts[s].to_pylist()[1:-1]) < BYTES for s in cut)
    assert [*pieces(texts[:0])] == [] and [*pieces(texts[5:6])] == [slice(0, 1)]


def test_pages_leave_a_few_at_a_time():
    page = "<title>T</title><p>" + "word " * 20_000 + "</p><a href='/b'>b</a>"
    batch = pa.array([page] * 90 + [None]), pa.array(["https://h.example/a"] * 91)
    read = [*read_html.func(iter([batch]))]
    assert len(read) > 3 and all(r.nbytes < 2 * BYTES for r in read)
    rows = [x for r in read for x in r.to_pylist()]
    assert len(rows) == 91 and rows[0]["title"] == "T" and rows[0]["links"] == ["https://h.example/b"] and rows[-1] == {"title": "", "raw": "", "links": []}


def test_vectors_leave_a_few_at_a_time():
    made = [*hash_embedder(1024).func(iter([pa.array(["A b  a", None, ""] * 400)]))]
    assert all(len(m) <= ROWS for m in made)
    rows = [np.array(x, dtype=np.float32) for m in made for x in m.to_pylist()]
    assert len(rows) == 1200 and sorted(rows[0][rows[0] != 0]) == sorted(np.float32([1, 2]) / np.float32(np.sqrt(5)))
    assert not rows[1].any() and not rows[2].any()


def test_pieces_keep_the_order_of_rows(spark):
    rows = spark.range(3000, numPartitions=2).withColumn("t", F.concat(F.lit("w"), F.col("id")))
    own, other = hash_embedder(512)("t"), F.concat(F.lit("<p>"), F.col("t"), F.lit("</p>"))
    made = rows.select("t", own.alias("v"), read_html(other, F.lit("https://h.example/")).alias("h")).where(r"regexp_replace(h.raw, '[\\s]', '') = t and aggregate(v, 0D, (s, x) -> s + x) = 1")
    assert made.count() == 3000


def test_words_are_hashed_as_one_by_one():
    def fnv(word):
        h = 0x811C9DC5
        for byte in word.encode():
            h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
        return h

    words = ["a", "foobar", "", "é" * 32, "é" * 33, "x" * 64, "x" * 65, "كلمة", "b", "👍"]
    assert fnv("a") == 0xE40C292C and _hashes(words).tolist() == [fnv(w) for w in words]
    assert _hashes([]).tolist() == [] and _hashes(["y" * 99]).tolist() == [fnv("y" * 99)]


def test_white_space_of_every_kind(spark):
    kinds = [*map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
    others = [*map(chr, (0x1C, 0x1F, 0x200B, 0x2060, 0x180E, 0xFEFF))]
    texts = [f"{k}{n}a{k}b {k}c{k} d  e{n}{k}" for k in kinds + others for n in (" ", "\n", "")] + ["", " ", "\u3000\t", "a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("t", trim_space(F.col("t")).alias("trimmed"), collapse_space(F.col("t")).alias("one"), normalize_arabic(F.col("t")).alias("norm")).collect()
    ws = "".join(kinds)
    for r in rows:
        if r["t"] is None:
            assert r["trimmed"] is r["one"] is r["norm"] is None
            continue
        spaced = "".join(" " if c in kinds else c for c in r["t"])
        assert r["trimmed"] == r["t"].strip(ws) and r["one"] == r["norm"] == " ".join(p for p in spaced.split(" ") if p)


def test_ends_of_sentences(spark):
    rows = spark.createDataFrame([("a.b 3.5 4. 5.c .6 7.؟8!9۔1.2.3\n4..5",)], "t string").select(split_sentences(F.col("t")).alias("s")).collect()
    assert rows[0]["s"] == ["a.", "b 3.5 4.", "5.", "c .", "6 7.", "؟", "8!", "9۔", "1.2.3", "4.", ".", "5"]
