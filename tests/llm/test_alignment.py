"""Alignment of two tokenizers against whole texts encoded by both libraries, pair by pair."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from conftest import SF
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quillspark.llm import alignment
from quillspark.llm.common import materialize, table


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner.of_files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def ranges(tokens):
    at, found = 0, []
    for token in tokens:
        found.append((at, at + len(token)))
        at += len(token)
    return found


def plain(texts):
    """``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every text, by definition."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    found = []
    for text in texts:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            coded = a.encode(" " + text, add_special_tokens=False)
            one = [(i, bytes(letters[c] for c in t)) for i, t in zip(coded.ids, coded.tokens, strict=True)]
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
            want = b" " + text.encode()
            if b"".join(t for _, t in one) == b"".join(t for _, t in two) == want:
                n_a, n_b = len(one), len(two)
                of_a, of_b = ranges([t for _, t in one]), ranges([t for _, t in two])
                ends = sorted({y for _, y in of_a} & {y for _, y in of_b})
                begins = [0, *ends[:-1]]
                by_a, by_b = defaultdict(list), defaultdict(list)
                for (i, _), (x, _) in zip(one, of_a, strict=True):
                    by_a[bisect_right(begins, x) - 1].append(i)
                for (i, _), (x, _) in zip(two, of_b, strict=True):
                    by_b[bisect_right(begins, x) - 1].append(i)
                groups = [f"{','.join(map(str, by_a[k]))}|{','.join(map(str, by_b[k]))}" for k in range(len(begins))]
                j = 0
                for (i, _), (x, y) in zip(one, of_a, strict=True):
                    while of_b[j][1] <= x:
                        j += 1
                    k = j
                    while k < len(two) and of_b[k][0] < y:
                        links.append((i, two[k][0]))
                        k += 1
        found.append((n_a, n_b, groups, links))
    count = Counter(pair for _, _, _, links in found for pair in set(links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in found
    ]


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "B", "é", " ", " ", "  ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "ﬁ", "①", "漢", "字", "🙂", "é", "1", "23", "'s", "don't", "word", "Word,", "<s>", "</s>", "<|endoftext|>", "<0x41>", "ا", "ل", "-", "...", "\0", "​", "ß"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += [None, "", " ", "   ", "\n", "a", " a ", "▁", "a ▁b c", "same text", "same text", "x" * 5000, "ab " * 40_000, "🙂" * 50]
    return texts


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 40, 0])
def test_odd_texts(spark, aligner, hot_pairs):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "mine", -1) for i, t in enumerate(texts)], "doc_id bigint, text string, key string, n_a int").repartition(5)
    linked = materialize(alignment.linked_documents(docs, aligner), "linked")
    got = {r["row"]["doc_id"]: r for r in alignment.score_links(linked, aligner, hot_pairs).collect()}
    assert [tuple(got[i][c] for c in COLUMNS) for i in range(len(texts))] == plain(texts)
    assert all(r["row"]["key"] == "mine" and r["row"]["n_a"] == -1 and r["row"]["text"] == texts[i] for i, r in got.items())


def test_whole_table(spark, aligner):
    rows = sorted(table(spark, SF, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in alignment.op12_alignment(spark, SF).collect()}
    assert [tuple(got[r["doc_id"]][c] for c in COLUMNS) for r in rows] == plain([r["text"] for r in rows])


def test_empty_table(spark, aligner):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    linked = materialize(alignment.linked_documents(docs, aligner), "linked")
    assert alignment.score_links(linked, aligner).count() == 0


def test_identity_array(aligner):
    hits = [(i, b) for i, b in enumerate(aligner.same) if b >= 0]
    assert len(hits) > 5000
    assert all(aligner.bytes_a[i] == aligner.bytes_b[b] for i, b in hits)


def test_rank_order_is_merge_order(aligner):
    """Every entry's letters merge into it by the list of merges; so no other pair that spells it ever meets."""
    for word, i in aligner.a.get_vocab(with_added_tokens=False).items():
        assert [t.id for t in aligner.a.model.tokenize(word)] == [i]


def test_plain_units_alone_and_together(aligner):
    rng = random.Random(3)
    letters = [chr(c) for c in range(33, 0x250) if not 127 <= c <= 160 and c != 173]
    units = sorted({"".join(rng.choice(letters[:94] if rng.random() < 0.7 else letters) for _ in range(rng.randint(1, 14))) for _ in range(30_000)})
    units += ["\n".join(units[i : i + 2]) for i in range(0, 2000, 2)] + [units[0] + "\n\n\n" + units[1]]
    assert all(map(aligner.is_plain, units)) and not any(map(aligner.is_plain, ["", "a b", "\na", "a\n", "a\t", "a\xa0b", "\xad", "漢"]))
    assert aligner.align_plain(units) == aligner.align(units)


def test_cut_is_the_same_either_way(aligner):
    for text in odd_texts():
        if text:
            assert aligner.cut(text) == aligner.split(text)
