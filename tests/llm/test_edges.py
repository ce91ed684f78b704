"""Nulls, empty texts, repeated rows, clashing columns and empty tables, for each operator."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF

from quillspark.llm import bpe, chat_format, components, exact_dedup, line_dedup, neighbours, packing, quality, simhash, toxicity, warc
from quillspark.llm.common import table
from quillspark.operators.ingest import extract_pages

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, label string, id string, sequence_id string, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, None), (None, "one two three four five six"), (4, " \n\t"), (5, "word " * 40_000)]
    return spark.createDataFrame([(i, t, None, None, None, 9, "x", "y", "z", None) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id = -1")


def models(spark):
    rng = np.random.default_rng(0)
    sample = [(" ".join(rng.choice(["nice", "calm", "tree", "road", "blue"], 30)) + (" vilest vermin scum" * 2 if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    return spark.createDataFrame(sample, "text string, label int")


def cases(spark):
    codec, path, sample = bpe.public_codec(), public_tokenizers.path("word_bpe_49k.json"), models(spark)
    toxic, good = toxicity.fit_toxicity(sample), quality.fit_quality(sample)
    return {
        "bpe": lambda d: bpe.decode_ids(bpe.encode_documents(d, codec), codec),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxic),
        "quality": lambda d: quality.grade_quality(d, good),
        "lines": lambda d: line_dedup.drop_boilerplate(d, d["source"], count_col="gone"),
        "simhash": lambda d: simhash.near_duplicates(d),
        "similar": lambda d: simhash.similar_documents(d),
        "exact": lambda d: exact_dedup.exact_dedup(d),
        "warc": lambda d: warc.resolve_revisits(d.selectExpr("doc_id AS id", "n_chars AS bytes", "text AS digest")),
    } | {"packing": lambda d: packing.pack_documents(d, path).where("piece = 0")}


def test_each_row_has_a_result(spark, odd, none):
    for name, apply in cases(spark).items():
        assert apply(odd).count() == odd.count(), name
        assert apply(none).count() == 0, name


def test_defined_results(spark, odd):
    found = [(r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup.exact_dedup(odd).collect()]
    assert Counter(found) == Counter([(1, 1, True, 3), (1, 1, False, 3), (None, 1, False, 3), (2, 4, False, 4), (3, 4, False, 4), (4, 4, True, 4), (None, 4, False, 4), (5, 5, True, 1)])
    nameless = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a b")] * 3 + [(None, "c")], "doc_id long, text string")).collect()
    assert Counter((r["keep_id"], r["kept"], r["group_size"]) for r in nameless) == Counter({(None, True, 3): 1, (None, False, 3): 2, (None, True, 1): 1})
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert {(2, 2), (3, 2), (4, 2), (None, 2), (1, 1), (None, 1), (5, 5)} == groups


def test_models_without_labels(spark, odd):
    empty = models(spark).where("label = 7")
    assert {r["toxicity"]["predicted"] for r in toxicity.score_toxicity(odd, toxicity.fit_toxicity(empty)).collect()} == {0}
    assert quality.grade_quality(odd, quality.fit_quality(empty)).where(quality.is_kept()).count() == odd.count()


def test_chats(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "x")], "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_chats(chat_format.format_chats(rows)).collect()}
    assert got == {None: [("", "")], 1: [("", "x"), ("user", ""), ("user", "")]}
    assert chat_format.format_chats(rows.where("conv_id = 9")).count() == 0


def test_empty_archives_and_vectors(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(vectors, vectors["vec_id"] == 0).count() == 0


def test_near_copies_with_repeated_ids(spark):
    import corpus_pipeline

    rng = np.random.default_rng(21)
    a, b, c = (" ".join(f"{g}{i}" for i in rng.integers(0, 5000, 100)) for g in "abc")
    rows = [(1, a), (1, b), (2, a), (2, c), (3, b), (4, c), (None, c), (None, "alone"), (None, "alone"), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (docs, docs.orderBy("text"), docs.orderBy("doc_id")):
        kept = corpus_pipeline.drop_near_copies(spark, frame, "").collect()
        assert sorted((r["text"], r["doc_id"] or 0) for r in kept) == sorted([(a, 1), (b, 1), (c, 2), ("alone", 0)])


def test_near_copies_of_repeated_rows(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(300)), " ".join([*(f"w{i}" for i in range(299)), "other"]), "quite another text of a few words"]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)] * 40, "doc_id long, text string")
    trees, plain = [], simhash.materialize

    def kept(df, label):
        found = plain(df, label)
        if label == "shards":
            trees.extend([n["node"] for n in r["tree"]] for r in found.select("tree").collect())
        return found

    monkeypatch.setattr(simhash, "materialize", kept)
    groups = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar_documents(docs).collect())
    assert groups == Counter({(0, 0): 40, (1, 0): 40, (2, 2): 40})
    assert trees and all(len(nodes) == len(set(nodes)) for nodes in trees)


def test_no_inner_name_clashes(spark):
    """Columns named like those inside operators come back as they were."""
    kind = "doc_id long, length int, len string, salt string, rn int, base int, at string, `__len` int, `__salt` int, row string"
    rows = [(i, 100 + i % 7, "a", "b", 1, 2, "c", 3, 4, "r") for i in range(60)]
    packed = packing.pack(spark.createDataFrame(rows, kind), ["doc_id"]).collect()
    assert sorted(tuple(r)[:10] for r in packed) == sorted(rows) and packed[0].__fields__[10:] == ["sequence_id", "offset"]
    docs = spark.createDataFrame([("some text", "mine", 1)], "text string, both string, `__both` int")
    found = bpe.encode_documents(docs, bpe.public_codec(), decoded_col="decoded").first()
    assert (found["both"], found["__both"], bytes(found["decoded"])) == ("mine", 1, b"some text")


def test_page_lines_by_host(spark):
    """Boilerplate of every host of the whole table, against a plain version on the text that the library reads."""
    pages = extract_pages(table(spark, SF, "pages")).select("page_id", "url", "text").collect()
    key = lambda line: line.strip(" \t\r\f\v")
    hosts, seen = Counter(), defaultdict(Counter)
    for r in pages:
        host = r["url"].split("://")[1].split("/")[0].lower()
        hosts[host] += 1
        seen[host].update({key(x) for x in r["text"].split("\n")} - {""})
    gone = {h: {x for x, n in c.items() if n >= 2 and n > 0.1 * hosts[h]} for h, c in seen.items()}
    assert any(gone.values())
    want = {}
    for r in pages:
        lines = r["text"].split("\n")
        kept = [x for x in lines if key(x) not in gone[r["url"].split("://")[1].split("/")[0].lower()]]
        want[r["page_id"]] = (len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = {r["page_id"]: (r["lines_dropped"], r["text_sha256"]) for r in line_dedup.op4_line_dedup_pages(spark, SF).collect()}
    assert got == want and any(n for n, _ in got.values())


def test_components_of_odd_links(spark):
    kind = "u long, v long, root long"
    links = spark.createDataFrame([(5, 3, 0), (3, 5, 0), (3, 9, 0), (7, 7, 0), (None, 4, 0), (4, None, 0), (20, 21, 0), (21, 22, 0), (22, 20, 0)], kind)
    assert {r["node"]: r["root"] for r in components.connected_components(links.select("u", "v")).collect()} == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20}
    assert components.connected_components(links.select("u", "v").where("u > 100")).count() == 0


def test_a_very_long_chat_beside_columns_of_its_own(spark):
    """Twenty thousand turns, merged where roles repeat; columns named like those used inside are not read."""
    said = [(1, n, "user" if n % 5 < 3 else "assistant", f"turn {n} </s>" * (n % 3), "x", 7, "y") for n in range(20_000)]
    rows = spark.createDataFrame(said, "conv_id long, turn int, role string, text string, pos string, block int, t string").repartition(4)
    formatted = chat_format.format_chats(rows)
    chat = chat_format.read_chats(formatted).first()
    assert [(t["role"], t["text"]) for t in chat["turns"]] == [r[2:4] for r in said]
    assert sum(s["length"] for s in formatted.first()["loss_spans"]) >= sum(len(r[3]) for r in said if r[2] == "assistant")
