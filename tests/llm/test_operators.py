"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from conftest import SF
from oracle import check
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, components, exact_dedup, line_dedup, neighbours, packing, quality, registry, simhash, toxicity, warc

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_byte_bpe_is_tiktokens(spark, documents):
    ranks = dict(zip(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), range(10**6), strict=False))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in zip(documents.doc_id, documents.text.fillna(""), strict=True):
        ids = coder.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r[0]: tuple(r[1:4]) for r in bpe.op1_byte_bpe(spark, SF).collect()} == want


@pytest.mark.parametrize("text", ["", " ", "a", "  a  b ", "\n\n x  y z", "don't DON'T 12345 ...!!", "مرحبا 世界 \U0001f600", "zq" * 3000, " ́x" * 50])
def test_byte_bpe_odd_texts(text):
    codec = bpe.public_codec()
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: i for i, e in enumerate(codec.entries)}, special_tokens={})
    ids = codec.encode(text).tolist()
    assert ids == coder.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_byte_bpe_in_one_pass_and_in_two(spark):
    codec = bpe.public_codec()
    texts = [(1, "two  words, two", "old"), (2, None, "old"), (2, "", None), (1, "two  words, two", "old"), (None, "\u00e9t\u00e9 \U0001f600 " * 500, "old")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, ids string").withColumn("Decoded", F.lit(0))
    one = bpe.encode_documents(docs, codec, decoded_col="decoded")
    two = bpe.decode_ids(bpe.encode_documents(docs.drop("Decoded"), codec), codec)
    assert one.columns == ["doc_id", "text", "ids", "decoded"]
    rows = one.collect()
    assert sorted(map(str, rows)) == sorted(map(str, two.select(one.columns).collect()))
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["ids"] == codec.encode(r["text"] or "").tolist() for r in rows)
    assert bpe.encode_documents(docs.limit(0), codec, decoded_col="decoded").count() == 0
    assert one.select(F.size("ids"), "ids", "decoded")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_perfect_hash_is_minimal():
    keys = [str(i * i).encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.ranks) == list(range(5000))
    assert [table.rank(k) for k in keys] == list(range(5000))
    assert table.rank(b"none") == -1


def held_out_accuracy(rows, labels, column):
    known = {i: v for i, v in zip(labels.doc_id, labels[column], strict=True) if zlib.crc32(str(i).encode()) % 3 == 1 and v == v}
    return np.mean([r["predicted"] == known[r["doc_id"]] for r in rows if r["doc_id"] in known])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op2_toxicity(spark, sf).collect()
    assert len(rows) == len(pd.read_parquet(f"{sf}/documents.parquet"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert held_out_accuracy(rows, pd.read_parquet(f"{sf}/labels.parquet"), "toxic") >= 0.95


def segments_by_definition(scores):
    """Best segment, then the same left and right of it."""
    n, best, at = len(scores), 0, None
    for i in range(n):
        total = 0
        for j in range(i, n):
            total += scores[j]
            if total > best:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    return segments_by_definition(scores[:i]) + [(i, j, best)] + [(a + j + 1, b + j + 1, s) for a, b, s in segments_by_definition(scores[j + 1 :])]


def test_maximal_segments_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = [float(s) if s > 0 else -0.5 for s in rng.choice([0, 0, 0, 1, 2, 3], size=rng.integers(1, 40)) * rng.uniform(0.5, 1.5)]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(at, [scores[i] for i in at], 0.5)
        want = segments_by_definition(scores)
        assert round(sum(s for _, _, s in got), 6) == round(sum(s for _, _, s in want), 6)
        assert len(got) == len(want)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op7_quality(spark, sf).collect()
    assert len(rows) == len(pd.read_parquet(f"{sf}/documents.parquet"))
    assert held_out_accuracy(rows, pd.read_parquet(f"{sf}/labels.parquet"), "quality") >= 0.9


def test_quality_thresholds_are_ordered():
    rows = [(i % 3, np.array([i % 3]), np.array([1.0])) for i in range(300)]
    w, t = quality.refine(np.zeros(4), np.array([-1.0, 1.0]), rows, 5, 0.5)
    assert t[0] <= t[1] and w[0] < w[1] < w[2]


def test_warc_round_trip(spark, tmp_path):
    html = ["x" * 1500, "x" * 1500, None, "short", "short", "\r\n\r\nWARC/1.1\r\n" * 100, "é世" * 600, "é世" * 600]
    rows = [(i, f"http://a.example/{i}" if i else None, h, "extra") for i, h in enumerate(html)]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, value string"), path)
    read = {r["id"]: r for r in warc.read_archives(spark, path).collect()}
    assert {i: r["payload"].decode() for i, r in read.items() if r["type"] == "response"} == {i: html[i] or "" for i in (1, 2, 3, 4, 5, 7)}
    assert {i: r["refers_to"] for i, r in read.items() if r["type"] == "revisit"} == {0: 1, 6: 7}
    full = {r["id"]: (r["bytes"], r["digest"]) for r in warc.resolved_records(warc.read_archives(spark, path)).collect()}
    assert full == {i: (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, h in enumerate(html)}


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    rng = np.random.default_rng(3)
    pages = [(i, "http://a.example/", rng.bytes(2000).hex()) for i in range(200)] + [(i % 3 or None, None, "z" * 1000) for i in range(9)]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    sizes = [sum(len(r["payload"]) for r in warc.parse_archive(gzip.open(f))) for f in (tmp_path / "warc").glob("*.gz")]
    assert len(sizes) > 8 and max(sizes) < 200_000
    read = warc.read_archives(spark, path).select("id", "type", "refers_to").where("id is null or id < 3").collect()
    # Of the nine short-lived copies, rows with id 2 tie on the largest id, rows without an id never are revisits.
    assert sorted((r["id"] or -1, r["type"], r["refers_to"]) for r in read if r["id"] is None) == [(-1, "response", None)] * 3
    assert sum(r["type"] == "revisit" and r["refers_to"] == 2 for r in read) == 3


def test_line_dedup_by_site(spark):
    rows = [(i, "http://a.example/x", f"menu \nown {i}\n\nmenu") for i in range(20)] + [(100 + i, "http://b.example/", "menu\n") for i in range(1)] + [(200, None, None), (201, "http://A.example:80/", "")]
    pages = spark.createDataFrame(rows, "id long, url string, text string")
    got = {r["id"]: (r["text"], r["n"]) for r in line_dedup.drop_boilerplate(pages, line_dedup.host_of(pages["url"]), count_col="n").collect()}
    assert got == {i: (f"own {i}\n", 2) for i in range(20)} | {100 + i: ("menu\n", 0) for i in range(1)} | {200: (None, 0), 201: ("", 0)}


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_line_dedup_edges(spark, monkeypatch, limit):
    """A share of exactly the ratio stays; null sites are one site; clashing names and both joins give the same."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    rows = [(i, "s", "over\nat" if i < 2 else "over" if i < 3 else f"own {i}", i, "x") for i in range(20)] + [(50 + i, None, "null site\n  null site\t", i, "y") for i in range(2)] + [(60, None, None, 0, "z")]
    pages = spark.createDataFrame(rows, "lines long, site string, text string, page long, gone string")
    got = line_dedup.drop_boilerplate(pages, pages["site"], count_col="n")
    assert got.columns == ["lines", "site", "text", "page", "gone", "n"]
    want = {0: ("at", 1), 1: ("at", 1), 2: ("", 1)} | {i: (f"own {i}", 0) for i in range(3, 20)} | {50: ("", 2), 51: ("", 2), 60: (None, 0)}
    assert {r["lines"]: (r["text"], r["n"]) for r in got.collect()} == want
    assert line_dedup.drop_boilerplate(pages.where("lines < 0"), pages["site"]).count() == 0


def reference_pieces(documents):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for i, text in zip(documents.doc_id, documents.text.fillna(""), strict=True):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            out[i, piece] = (start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    return out


def assert_packed(rows):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by_sequence)


def first_fit_decreasing(lengths):
    rooms = []
    for n in sorted(lengths, reverse=True):
        for i, room in enumerate(rooms):
            if room >= n:
                rooms[i] -= n
                break
        else:
            rooms.append(4096 - n)
    return len(rooms)


def test_packing(spark, documents):
    rows = packing.op5_packing(spark, SF).collect()
    want = reference_pieces(documents)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    lengths = [n for _, n, _ in want.values()]
    assert -(-sum(lengths) // 4096) <= assert_packed(rows) <= first_fit_decreasing(lengths)


def test_packing_plan_places_all():
    rng = np.random.default_rng(1)
    for case in range(60):
        sizes = rng.integers(1, 4097 if case % 2 else 1500, size=rng.integers(1, 60)).tolist()
        fixed, left = packing.reduce_instance(Counter(sizes))
        bins = fixed + packing.best_fit(left)
        used = Counter()
        for n, runs in bins:
            assert sum(s * k for s, k in runs) <= 4096
            for s, k in runs:
                used[s] += n * k
        assert used == Counter(sizes)
        assert sum(n for n, _ in bins) <= first_fit_decreasing(sizes)


ODD_TEXTS = [
    "", " ", "  ", "İstanbul ﬁn", "a.b,c. D, e.", "<|startoftext|> x <|endoftext|>", "<|ENDOFTEXT|> A<|endoftext|>b. word<|endoftext|>.", "don't it's we'LL 123abc", "世界　x\ty\nz", "x" * 5000, "naïve ǅ ẞ Σς",
    "ªº² word' word's, it's. l'eau", "a\n\nb\r\nC", "e\u0301x E\u0301", "\x1cA b\x1d", "straße. ÀÉ ÿ µ", "Œuvre Łódź ŉ Ⱥ", "مرحبا 2024", "\U0001f600!", "a" * 200 + "." * 300,
]


def test_batch_tokenizer_is_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.BatchTokenizer(path)
    for texts in ([], ODD_TEXTS, ODD_TEXTS[5:9], *([t] for t in ODD_TEXTS)):
        ids, bounds = own(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_batches_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 10)
    texts = ["a" * n for n in (0, 3, 40, 0, 9, 9, 1)]
    parts = [*packing.batches_of(pa.array(texts))]
    assert [t for _, part in parts for t in part.to_pylist()] == texts
    assert [at for at, _ in parts] == [*np.cumsum([0, *(len(p) for _, p in parts)])[:-1]]


def test_special_tokens_are_packed_as_the_library_gives_them(spark):
    texts = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, None)]
    rows = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["length"] for r in rows} == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts}
    assert_packed(rows)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, linked):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if linked(prints[i], prints[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_by_brute_force(spark, documents):
    docs = documents.sort_values("doc_id").reset_index(drop=True)
    prints = [plain_fingerprint(t) for t in docs.text]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = {int(i): (f"{p:016x}", int(docs.doc_id[r])) for i, p, r in zip(docs.doc_id, prints, roots, strict=True)}
    assert {r[0]: (r[1], r[2]) for r in simhash.op6_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("shard_rows", [8, 2048])
def test_links_by_brute_force(spark, shard_rows):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 2**63, 30, dtype=np.uint64)]
    for p in prints[:30]:
        for _ in range(6):
            for b in rng.choice(64, 2, replace=False):
                p ^= 1 << int(b)
            prints.append(p)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 2, shard_rows)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    unsigned = [p & (1 << 64) - 1 for p in prints]
    want = plain_components(unsigned, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [roots.get(p, p) for p in prints] == [prints[r] for r in want]


def test_similar_documents_finds_planted(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    rows, expected = [], {}
    for g in range(40):
        text = rng.choice(words, 300).tolist()
        rows.append((10 * g, " ".join(text)))
        near = text.copy()
        near[150] = "changed"  # similarity about 0.97
        rows.append((10 * g + 1, " ".join(near)))
        rows.append((10 * g + 2, " ".join(text).upper()))
        far = [w if i % 4 else "other" for i, w in enumerate(text)]
        rows.append((10 * g + 3, " ".join(far)))
        expected |= {10 * g: 10 * g, 10 * g + 1: 10 * g, 10 * g + 2: 10 * g, 10 * g + 3: 10 * g + 3}
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == expected


@pytest.mark.parametrize("options", [{}, {"capacity": 1}, {"key_bits": 2, "capacity": 2}])
def test_exact_dedup_by_brute_force(spark, documents, options):
    groups = defaultdict(list)
    for i, text in zip(documents.doc_id, documents.text.fillna(""), strict=True):
        groups[BLANKS.sub("", text)].append((-len(text), i))
    want = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        want |= {i: (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, i in members}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r[0]: tuple(r[1:]) for r in exact_dedup.exact_dedup(docs, **options).collect()} == want


def test_directory_doubles_without_a_ceiling(spark, monkeypatch):
    """Keys that agree in 40 leading bits still part, no bucket is overfull, and only overfull ones are split; with and without broadcast."""
    keys = sorted({*(int(x) for x in np.random.default_rng(2).integers(0, 2**63, 300)), *(-(1 << 62) + (i << 3) for i in range(200)), -1, 0})
    rows = spark.createDataFrame([(k, "mine") for k in keys + keys[:50]], "key long, split string").drop("split")
    for most in (exact_dedup.BROADCAST_BUCKETS, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_BUCKETS", most)
        found = exact_dedup.directory(rows, 4)
        assert len(found.depths) > 5 and found.depths == sorted(set(found.depths)) and len(found.overfull) == len(found.depths) - 1
        buckets = defaultdict(set)
        for r in exact_dedup.with_bucket(rows, found).collect():
            buckets[r["bucket"] % 2**64].add(r["key"] % 2**64)
        assert sum(map(len, buckets.values())) == len(keys) and max(map(len, buckets.values())) <= 4
        ranges = sorted((min(k), max(k), start) for start, k in buckets.items())
        assert all(start <= low for low, _, start in ranges) and all(a[1] < b[2] for a, b in zip(ranges, ranges[1:], strict=False))
    assert exact_dedup.directory(rows.limit(0), 4).depths == [1]


def test_chat_format(spark):
    from quillspark.llm import chat_format

    rows = pd.read_parquet(f"{SF}/conversations.parquet")
    convs = defaultdict(list)
    for r in rows.itertuples():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for i, turns in convs.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        want[i] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {r[0]: tuple(r[1:5]) for r in chat_format.op9_chat_format(spark, SF).collect()} == want


def test_chat_escapes_are_reversible(spark):
    from quillspark.llm import chat_format

    texts = ["<s>", r"<\s>", r"<\\s>[INST]", "[+]", r"[\+]\\", "[[INST]", "</s></s>", "\\", "$1\\$2", "[/INST]\n<s>user[INST]x", "", None]
    rows = [(0, n, "assistant" if n % 3 else "us[INST]er", t) for n, t in enumerate(texts)]
    chats = chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).first()
    assert [(t["role"], t["text"]) for t in chats["turns"]] == [(r, t or "") for _, _, r, t in rows]


def test_chat_masks_are_the_texts(spark):
    """Spans hold the escaped texts exactly; long runs, several conversations, a null id and clashing columns."""
    from quillspark.llm import chat_format

    rng = np.random.default_rng(8)
    words = ["<s>", "[INST]", "[+]", "\\", "ok", "é", "", "</s>[", "[/INST]", "\n"]
    rows = [(i or None, n, str(rng.choice(["assistant", "user", "us[+]er"])), "".join(rng.choice(words, rng.integers(0, 6))), "x", 7) for i in range(6) for n in range(60)]
    rows += [(99, n, "assistant", f"t{n}", "x", 7) for n in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, block string, pos int")
    chats = chat_format.format_chats(turns)
    masked = {r["conv_id"]: r["masked"] for r in chat_format.masked_texts(chats).collect()}
    for chat in chat_format.read_chats(chats).collect():
        own = [r for r in rows if r[0] == chat["conv_id"]]
        assert [(t["role"], t["text"]) for t in chat["turns"]] == [(r[2], r[3]) for r in own]
        said = [r[3] for r in own if r[2] == "assistant"]
        spans = [chat["formatted"][s["start"] : s["start"] + s["length"]] for s in chat["loss_spans"]]
        assert [re.sub(r"([<\[])\\(\\*)(s>|INST\]|\+\]|/INST\]|/s>)", r"\1\2\3", s) for s in spans] == said
        assert masked[chat["conv_id"]] == "".join(said)


def recall(got, vectors, ids, queries):
    """Share of the exact ten nearest that were found; every score must be exact, and ranks in order."""
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in queries:
        far = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        hits, total = hits + len({v for v, _ in found[q]} & set(best.tolist())), total + len(best)
        for v, score in found[q]:
            assert score == pytest.approx(far[ids == v][0], abs=1e-12)
        assert [(s, v) for v, s in found[q]] == sorted((s, v) for v, s in found[q]) and len(found[q]) == len(best)
    return hits / total


@pytest.mark.parametrize(("sf", "options"), [("sf0.001", {}), ("sf0.01", {"block_rows": 60}), ("sf0.1", {"block_rows": 300})])
def test_neighbours_recall(spark, sf, options):
    rows = pd.read_parquet(f"/root/testdata/{sf}/embeddings.parquet")
    ids, vectors = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = neighbours.nearest_neighbours(table, table["vec_id"] % 100 == 0, **options).collect()
    assert recall(got, vectors, ids, ids[ids % 100 == 0]) >= 0.9


def test_neighbours_with_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((400, 16))
    vectors[::3] = vectors[0]
    ids = np.arange(400)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(frame, frame["vec_id"] % 100 == 0, block_rows=50).collect()
    assert recall(got, vectors, ids, [0, 100, 200, 300]) >= 0.9


def test_neighbours_repeated_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(1, [1.0, 0.5])] * 3 + [(2, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(frame, frame["vec_id"] == 0, block_rows=2).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 1), (3, 1), (4, 2)]


def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, -0.1]), (100, [1.0, 0.1])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, vectors string")
    got = [tuple(r) for r in neighbours.nearest_neighbours(vectors, vectors["vec_id"] % 100 == 0, 2).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 8), (100, 1, 1), (100, 2, 0)]


def test_similar_documents_counts_a_shingle_once(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(40):
        text, line = "\n".join([" ".join(rng.choice(words, 300)), ""]), " ".join(rng.choice(words, 8)) + "\n"
        rows += [(2 * g, text + line * 2), (2 * g + 1, text + line * 60)]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(80)}


def planted_pairs(number, seed=13):
    """Pairs of texts of 60 to 600 words with set similarity from 0.7 to 0.9, as (similarity, text, text)."""
    rng = np.random.default_rng(seed)
    pairs = []
    for g in range(number):
        n = int(rng.integers(60, 600))
        text = [f"{g}w{i}" for i in rng.integers(0, 5000, n)]
        near, edits = text.copy(), max(1, round(n * rng.uniform(0.011, 0.035)))
        for at in rng.choice(n, edits, replace=False):
            near[at] = f"new{at}"
        x, y = ({tuple(t[i : i + 5]) for i in range(n - 4)} for t in (text, near))
        similarity = len(x & y) / len(x | y)
        if 0.7 <= similarity <= 0.9:
            pairs.append((similarity, " ".join(text), " ".join(near)))
    return pairs


def test_similar_documents_by_brute_force(spark):
    pairs = planted_pairs(1500)
    rows = [(2 * g + k, pair[1 + k]) for g, pair in enumerate(pairs) for k in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [got[2 * g + 1] == 2 * g for g in range(len(pairs))]
    alike = [ok for ok, pair in zip(linked, pairs, strict=True) if pair[0] >= 0.8]
    assert len(alike) > 300 and np.mean(alike) >= 0.99, np.mean(alike)
    assert not any(ok for ok, pair in zip(linked, pairs, strict=True) if pair[0] < 0.8)


def test_similar_links_are_verified_in_split_shards(spark):
    rng = np.random.default_rng(17)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = base.copy()
        for at in rng.choice(400, 9, replace=False):
            text[at] = f"new{i}x{at}"
        rows.append((i, " ".join(text)))
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(396)} for _, t in rows]
    want = plain_components(shingles, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for shard_rows in (4, 2048):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame, shard_rows=shard_rows).collect()}
        assert [got[i] for i in range(60)] == want


def test_pipeline_boilerplate_at_every_size(spark):
    import corpus_pipeline

    rows = []
    for pages in (30, 50, 500):
        for i in range(pages):
            lines = ["menu"] * (10 * i < pages) + [f"own {i}"] + ["copied"] * (i < 2 or 25 * i < pages)
            rows.append((f"{pages}", "\n".join(lines)))
    got = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, "source string, text string"), "").collect()
    assert not any("menu" in r["text"] for r in got)
    assert sum("copied" in r["text"] for r in got) == 2 + 2 + 20
