"""Alignment of two tokenizers: which ids of one stand for the same text as which of the other.

Both encode a text after one space (one of them adds it by itself).  Byte offsets at
which tokens of both end cut the tokens into groups; tokens of a group whose byte ranges
overlap are linked.  A pair of ids counts the documents of the corpus that hold it
linked.

Identity fast path: an array gives for every id of the first vocabulary the id of the
second with the same bytes.  Such pairs, which groups of one token each are made of, are
counted in one vector over the vocabulary per task.  Only the pairs of irregular groups
are shuffled, counted per batch before.  Scores look identity pairs up in a vector and
irregular ones in a broadcast table of the ``HOT_PAIRS`` most frequent; the rest, whose
number has no bound, is joined by pair, where no pair is hot any more.

White space between two visible characters begins a token of both vocabularies (which is
checked for the second), so a text is cut there into units, each aligned once and
remembered.  Plain units (visible Latin letters, digits, punctuation, and line feeds between
them) are aligned many at a time in numpy, and the first vocabulary encodes them by rank: every entry's own bytes
merge into it, so merging by rank and by the list of merges are the same.  A text whose
units don't come out byte for byte is encoded whole.

Null and empty texts, and texts whose tokens don't spell the text byte for byte (a text
that holds the second's mark of a space, say), have no tokens: all counts are zero.
Repeated rows are documents each; documents of any length are aligned whole; an empty
table gives no rows.  Columns of the input are kept, packed in ``row``, so none clashes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, table

#: Irregular pairs that are broadcast at most, the most frequent ones (36 MB).
HOT_PAIRS = 1 << 21
#: Units remembered per Python worker, and the longest of them; the memory is emptied when full.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 40
#: Units that are encoded as one text.
TOGETHER = 1000
#: Documents whose links are sent on together, and links at which fewer are.
ROWS, LINKS = 512, 1 << 20
#: Mark of a space in the second vocabulary.
SPACE = "▁"


#: A stretch of text aligned: tokens of either side, groups, links; groups as text, and links (``a << 32 | b``) as bytes.
Unit = tuple[int, int, int, int, bytes, bytes]


def link_tokens(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[list[str], list[int]]:
    """Groups as ``a1,a2|b1``, and all overlapping pairs, of tokens that spell the same bytes."""
    groups, links = [], []
    i = j = from_i = from_j = 0
    end_a, end_b = size_a[a[0]], size_b[b[0]]
    while True:
        links.append(a[i] << 32 | b[j])
        if end_a == end_b:
            i, j = i + 1, j + 1
            groups.append(f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
            if i == len(a):
                return groups, links
            from_i, from_j = i, j
            end_a, end_b = end_a + size_a[a[i]], end_b + size_b[b[j]]
        elif end_a < end_b:
            i += 1
            end_a += size_a[a[i]]
        else:
            j += 1
            end_b += size_b[b[j]]


class Aligner:
    """Both tokenizers, from their files' contents; remembers the units it has aligned."""

    def __init__(self, json_a: str, model_b: bytes, pattern: str):
        self.json_a, self.model_b, self.pattern = json_a, model_b, pattern
        self._ready()

    @classmethod
    def of_files(cls, path_a: str, path_b: str, pattern: str) -> Aligner:
        """``pattern`` is that of the first vocabulary's pre-tokens."""
        with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
            return cls(a.read(), b.read(), pattern)

    def __getstate__(self) -> tuple[str, bytes, str]:
        return self.json_a, self.model_b, self.pattern

    def __setstate__(self, state: tuple[str, bytes, str]) -> None:
        self.json_a, self.model_b, self.pattern = state
        self._ready()

    def _ready(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(self.json_a), SentencePieceProcessor(model_proto=self.model_b)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = self._entries_a(), self._entries_b()
        self.size_a, self.size_b = [*map(len, self.bytes_a)], [*map(len, self.bytes_b)]
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError("a piece of the second vocabulary reaches over a space")
        by_bytes = {entry: i for i, entry in reversed([*enumerate(self.bytes_b)]) if entry and not self.b.is_byte(i)}
        lone = {entry: i for i, entry in enumerate(self.bytes_b) if self.b.is_byte(i)}
        self.same = np.array([by_bytes.get(entry, lone.get(entry, -1)) for entry in self.bytes_a], dtype=np.int64)
        letters = {entry: i for i, entry in enumerate(self.bytes_a) if entry}
        self.rank_a = tiktoken.Encoding("a", pat_str=self.pattern, mergeable_ranks=letters, special_tokens={}).encode_ordinary
        self.sizes_a, self.sizes_b = np.array(self.size_a), np.array(self.size_b)
        self.told = [np.array([f"{i}{mark}" for i in range(max(len(self.size_a), len(self.size_b)))], dtype=object) for mark in ",|;"]
        self.split = regex.compile(r"(?<=[^\s\p{Z}\p{C}]) (?=[^\s\p{Z}\p{C}])").split
        self.is_plain = re.compile(r"[!-~\xa1-\xac\xae-\u024f]+(?:\n+[!-~\xa1-\xac\xae-\u024f]+)*").fullmatch
        self.memo: dict[str, Unit | None] = {}

    def _entries_a(self) -> list[bytes]:
        """Bytes of the first vocabulary's entries, which write each byte as a letter."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in visible]
        byte_of = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}
        entries = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for word, i in json.loads(self.json_a)["model"]["vocab"].items():
            entries[i] = bytes(map(byte_of.__getitem__, word))
        return entries

    def _entries_b(self) -> list[bytes]:
        """Bytes of the second vocabulary's pieces; control marks spell nothing."""
        entries = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            lone, mute = self.b.is_byte(i), self.b.is_control(i) or self.b.is_unknown(i)
            entries.append(bytes([int(piece[3:5], 16)]) if lone else b"" if mute else piece.replace(SPACE, " ").encode())
        return entries

    def align(self, texts: list[str]) -> list[Unit | None]:
        """Every text, none of them empty, aligned with a space before it; None if its bytes don't come out."""
        of_a = [x.ids for x in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        of_b = self.b.encode(texts, num_threads=1)
        found: list[Unit | None] = []
        for text, a, b in zip(texts, of_a, of_b, strict=True):
            raw = b" " + text.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                found.append(None)
                continue
            groups, links = link_tokens(a, b, self.size_a, self.size_b)
            found.append((len(a), len(b), len(groups), len(links), ";".join(groups).encode(), np.array(links, dtype=np.int64).tobytes()))
        return found

    def align_plain(self, units: list[str]) -> list[Unit | None]:
        """``align`` for plain units, all at once: places are bytes in the units end to end, a space before each."""
        if not units:
            return []
        of_a = np.array([i for at in range(0, len(units), TOGETHER) for i in self.rank_a(" " + " ".join(units[at : at + TOGETHER]))])
        of_b = np.array([*chain.from_iterable(self.b.encode(units, num_threads=1))])
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        end_a, end_b = np.cumsum(self.sizes_a[of_a]), np.cumsum(self.sizes_b[of_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)  # where groups end
        if len(np.setdiff1d(ends, common, assume_unique=True)):
            return self.align(units)
        in_a, in_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        n_a, n_b = (np.bincount(x, minlength=len(common)) for x in (in_a, in_b))

        first = np.searchsorted(end_b, end_a - self.sizes_a[of_a], side="right")
        times = np.searchsorted(end_b - self.sizes_b[of_b], end_a) - first
        links = np.repeat(of_a, times) << 32 | of_b[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]

        comma, bar, semicolon = self.told
        words = np.empty(len(of_a) + len(of_b), dtype=object)
        last_a, last_b = np.append(in_a[1:] != in_a[:-1], True), np.append(in_b[1:] != in_b[:-1], True)
        words[np.arange(len(of_a)) + (np.cumsum(n_b) - n_b)[in_a]] = np.where(last_a, bar[of_a], comma[of_a])
        words[np.arange(len(of_b)) + np.cumsum(n_a)[in_b]] = np.where(last_b, semicolon[of_b], comma[of_b])
        words, raw = words.tolist(), links.tobytes()

        to_a, to_b, to_group = (np.searchsorted(x, ends) + 1 for x in (end_a, end_b, common))
        to_link = np.cumsum(times)[to_a - 1]
        found: list[Unit | None] = []
        a = b = g = k = 0
        for a2, b2, g2, k2 in zip(to_a.tolist(), to_b.tolist(), to_group.tolist(), to_link.tolist(), strict=True):
            found.append((a2 - a, b2 - b, g2 - g, k2 - k, "".join(words[a + b : a2 + b2])[:-1].encode(), raw[8 * k : 8 * k2]))
            a, b, g, k = a2, b2, g2, k2
        return found

    def cut(self, text: str) -> list[str]:
        """Units of a text: it is cut at spaces between visible characters."""
        if text.replace("\n", "").isprintable() and not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text):
            return text.split(" ")  # its only white space are such spaces, and line feeds
        return self.split(text)

    def texts(self, texts: list[str | None]) -> Iterator[list[Unit] | None]:
        """The units of every text; None where it has no tokens."""
        cuts = [self.cut(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        memo = self.memo
        missing = [*set(chain.from_iterable(cuts)).difference(memo)]
        plain = [u for u in missing if self.is_plain(u)]
        odd = [*set(missing).difference(plain)]
        long = {}
        for units, found in ((plain, self.align_plain(plain)), (odd, self.align(odd))):
            for unit, aligned in zip(units, found, strict=True):
                (memo if len(unit) < MEMO_CHARS else long)[unit] = aligned
        for text, units in zip(texts, cuts, strict=True):
            found = [*map(memo.get, units)]
            if None in found:
                found = [long.get(u) if x is None else x for u, x in zip(units, found, strict=True)]
                if None in found:
                    found = self.align([text])
            yield found if found and found[0] is not None else None


def _counted(links: bytes, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identity ids with how often they are linked, and other pairs with how often they are."""
    pairs, n = np.unique(np.frombuffer(links, dtype=np.int64), return_counts=True)
    alike = same[pairs >> 32] == (pairs & 0xFFFFFFFF)
    return (pairs[alike] >> 32).astype(np.int32), n[alike].astype(np.int32), pairs[~alike], n[~alike].astype(np.int32)


LINKED = "key long, row {row}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>"


def linked_documents(docs: DataFrame, aligner: Aligner, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with the columns of ``LINKED``: what is known of one without the corpus.

    ``key`` tells rows apart once they are written.
    """
    shared = docs.sparkSession.sparkContext.broadcast(aligner)
    row = F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), row, F.col(f"`{text_col}`").cast("string").alias("text"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, ROWS)
                size = np.cumsum([len(t.as_py() or "") for t in part.column("text")])
                part = part.slice(0, max(1, int(np.searchsorted(size, LINKS, side="right"))))
                at += len(part)
                yield packed(part, tool)

    def packed(part: pa.RecordBatch, tool: Aligner) -> pa.RecordBatch:
        sizes: list[tuple[int, int, int, int]] = []
        digests, lists = [], ([], [], [], [])
        for found in tool.texts(part.column("text").to_pylist()):
            if found is None:
                sizes.append((0, 0, 0, 0))
                digests.append("")
                values = [np.empty(0, dtype=np.int32)] * 2 + [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)]
            else:
                *counts, groups, links = zip(*found, strict=True)
                values = _counted(b"".join(links), tool.same)
                sizes.append(tuple(map(sum, counts)))
                digests.append(hashlib.sha256(b";".join(groups)).hexdigest())
            for into, value in zip(lists, values, strict=True):
                into.append(value)
        numbers = [pa.array([s[i] for s in sizes], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("row"), *numbers, pa.array(digests, pa.string()), *map(_lists, lists)],
            ["key", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pairs", "pairs_n"],
        )

    return rows.mapInArrow(link, LINKED.format(row=rows.schema["row"].dataType.simpleString()))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def pair_counts(linked: DataFrame, same: np.ndarray) -> DataFrame:
    """``(a, b, same, n)``: in how many documents each pair is linked, and whether it is an identity pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identity = np.zeros(len(same), dtype=np.int64)
        for batch in batches:
            identity += np.bincount(_flat(batch.column("same"))[0], minlength=len(same))
            pairs, n = np.unique(_flat(batch.column("pairs"))[0], return_counts=True)
            yield made(pairs >> 32, pairs & 0xFFFFFFFF, False, n)
        at = np.flatnonzero(identity)
        yield made(at, same[at], True, identity[at])

    def made(a: np.ndarray, b: np.ndarray, alike: bool, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array([alike] * len(a), pa.bool_()), pa.array(n.astype(np.int64))], ["a", "b", "same", "n"])

    return linked.select("same", "pairs").mapInArrow(count, "a int, b int, same boolean, n long").groupBy("a", "b", "same").agg(F.sum("n").alias("n"))


@dataclass
class Lookup:
    """Counts of identity pairs by first id, and of the hot irregular pairs, sorted; whether each is its first id's highest."""

    same_n: np.ndarray
    same_best: np.ndarray
    pairs: np.ndarray
    n: np.ndarray
    best: np.ndarray


def score_links(linked: DataFrame, aligner: Aligner, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``linked`` (as written) with ``n_best`` and ``count_sum``."""
    spark, same = linked.sparkSession, aligner.same
    counts = materialize(pair_counts(linked, same), "pair-counts")
    best = counts.groupBy(F.col("a").alias("its")).agg(F.max("n").alias("most"))  # a row for each id at most
    judged = counts.join(F.broadcast(best), F.col("a") == F.col("its"))
    judged = materialize(judged.select("a", "b", "same", "n", (F.col("n") == F.col("most")).alias("best")), "pairs-judged")
    pair = (F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))).alias("pair")

    vectors = judged.where("same").select("a", "n", "best").toArrow()
    same_n, same_best = np.zeros(len(same), dtype=np.int64), np.zeros(len(same), dtype=bool)
    same_n[vectors["a"].to_numpy()], same_best[vectors["a"].to_numpy()] = vectors["n"].to_numpy(), vectors["best"].to_numpy()
    irregular = judged.where("not same")
    steps = irregular.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("rows")).collect()  # 64 at most
    kept, least = 0, 64
    for step, rows in sorted(map(tuple, steps), reverse=True):
        kept += rows
        if kept > hot_pairs:
            break
        least = step
    hot = irregular.where(F.col("n") >= F.lit(2) ** least).select(pair, "n", "best").toArrow().sort_by("pair")
    rest = kept > hot_pairs
    lookup = Lookup(same_n, same_best, *(hot[c].to_numpy() for c in ("pair", "n", "best")))
    shared = spark.sparkContext.broadcast(lookup)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                yield scored(batch.slice(at, ROWS), known)

    def scored(part: pa.RecordBatch, known: Lookup) -> pa.RecordBatch:
        n = len(part)
        ids, each = _flat(part.column("same"))
        times, doc = _flat(part.column("same_n"))[0].astype(np.int64), np.repeat(np.arange(n), each)
        total, top = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        np.add.at(total, doc, times * known.same_n[ids])
        np.add.at(top, doc, times * known.same_best[ids])
        pairs, each = _flat(part.column("pairs"))
        times, doc = _flat(part.column("pairs_n"))[0].astype(np.int64), np.repeat(np.arange(n), each)
        place = np.minimum(np.searchsorted(known.pairs, pairs), max(0, len(known.pairs) - 1))
        met = known.pairs[place] == pairs if len(known.pairs) else np.zeros(len(pairs), dtype=bool)
        np.add.at(total, doc[met], times[met] * known.n[place[met]])
        np.add.at(top, doc[met], times[met] * known.best[place[met]])
        left = np.bincount(doc[~met], minlength=n)
        ends = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs[~met], times[~met])]
        kept = [part.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*kept, pa.array(top), pa.array(total), *lists], [*names, "n_best", "count_sum", "left", "left_n"])

    names = ["key", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = T.StructType([linked.schema[c] for c in names]).add("n_best", "long").add("count_sum", "long").add("left", T.ArrayType(T.LongType())).add("left_n", T.ArrayType(T.LongType()))
    met = linked.select(*names, "same", "same_n", "pairs", "pairs_n").mapInArrow(score, kind)
    if not rest:
        return met.drop("key", "left", "left_n")
    met = materialize(met, "links-met")
    links = met.select("key", F.explode(F.arrays_zip("left", "left_n")).alias("x")).select("key", F.col("x.left").alias("pair"), F.col("x.left_n").alias("times"))
    more = links.join(irregular.select(pair, "n", "best"), "pair").groupBy("key").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    whole = met.drop("left", "left_n").join(more, "key", "left")
    total = F.col("count_sum") + F.coalesce("more_sum", F.lit(0))
    top = F.col("n_best") + F.coalesce("more_best", F.lit(0))
    return whole.withColumns({"n_best": top, "count_sum": total}).drop("key", "more_sum", "more_best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligner = Aligner.of_files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    linked = materialize(linked_documents(docs, aligner, keep=["doc_id"]), "linked")
    return score_links(linked, aligner).select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
