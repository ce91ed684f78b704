"""The Merkle manifest against a plain version, tampering included, and its edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import merkle

KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string, row string, path int, seen double"
FIELDS = merkle.FIELDS


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, i):
    steps = []
    for level in levels[:-1]:
        first = i // 8 * 8
        steps.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return steps


def plain(rows):
    """``(doc_id, leaf, subroot, root, path)`` of every row."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row[0]))
    order = sorted(trees, key=lambda x: b"" if x is None else b"1" + x.encode())
    grown = {k: levels_of([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in order}
    top = levels_of([grown[k][-1][0] for k in order])
    found = []
    for at, k in enumerate(order):
        for i, (_, _, leaf, doc_id) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            found.append((doc_id, leaf, grown[k][-1][0], top[-1][0], tuple(path_of(grown[k], i) + path_of(top, at))))
    return found


def odd_rows():
    rows = [(i, f"s{i % 3}", f"l{i % 11:02}", i, f"Text {i} é") for i in range(150)]
    rows += [(1000 + i, None, "hot", None, None if i % 7 else "") for i in range(600)]
    rows += [(None, "s", "hot", 1, "x"), (None, "s", "hot", 1, "x"), (None, None, None, None, None), (5, "s", "", 0, "a" * 300_000)]
    rows += [(5, "s", "hot", 2, "same id"), (5, "s", "hot", 2, "same id"), (5, "s", "hot", 3, "same id")]
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), [(1, "s", "en", 1, "a")], [(i, "s", "en", 1, "a") for i in range(9)], []], ids=["odd", "one", "nine", "empty"])
def test_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "mine", 7, 0.5) for r in rows], KIND)
    found = merkle.manifest(docs, FIELDS, "lang", "doc_id", ["doc_id", "row", "path", "seen"])
    found = found.withColumn("end", merkle.fold(F.col("seen"), F.col("path")))
    got = found.select("row.doc_id", "leaf", "subroot", "root", "path", "row.row", "end").collect()
    assert sorted(((r[0], r[1], r[2], r[3], tuple(map(tuple, r["path"]))) for r in got), key=repr) == sorted(plain(rows), key=repr)
    assert all(r["row"] == "mine" and r["end"] == r["root"] for r in got)


def test_order_of_input_does_not_count(spark):
    rows = odd_rows()
    roots = set()
    for n in (1, 5):
        docs = spark.createDataFrame([(*r, "mine", 7, 0.5) for r in rows[::-1]], KIND).repartition(n)
        roots |= {r[0] for r in merkle.manifest(docs, FIELDS, "lang", "doc_id", ["doc_id"]).select("root").distinct().collect()}
    assert roots == {plain(rows)[0][3]}


def test_tampering_is_found(spark):
    rows = [(i, "s", f"l{i % 2}", i, f"Text {i}") for i in range(40)]
    docs = spark.createDataFrame([(*r, "mine", 7, 0.5) for r in rows], KIND)
    hit = F.col("doc_id") % 3 == 0
    seen = F.when(hit, merkle.leaf_digest([F.upper("text") if c == "text" else F.col(c) for c in FIELDS]))
    found = merkle.manifest(docs, FIELDS, "lang", "doc_id", ["doc_id"], seen)
    got = found.select("row.doc_id", (merkle.fold(F.col("seen"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r["doc_id"]: r["ok"] for r in got} == {i: i % 3 != 0 for i in range(40)}
