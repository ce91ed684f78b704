"""Best-fit packing of tokenised documents, after Martello-Toth dominance reduction.

Token ids come from a ``tokenizers`` vocabulary, as its library gives them without
added special tokens (those written in a text are special).  Each different word
of a batch of texts is encoded once.

Packing needs only how many pieces there are of each length, a histogram of at
most ``capacity`` counts whatever the size of the corpus.  The reduction fixes
every set that provably dominates all others with the same piece: a piece alone
when nothing else fits beside it, a piece with its exact complement, and pairs
or triples that no feasible alternative can beat.  Best fit (largest first) fills
the rest.  The plan gives bins as patterns with multiplicities; pieces find
their place from their rank among those of equal length.  Ranks are counted in
salted groups, so a length that a third of all pieces share is spread out.

Null texts are empty; an empty text is the end token alone.  Repeated rows are
packed each.  An empty table gives no rows; extra columns are not read by the
tokeniser and are passed on by ``pack``; its two own columns replace clashing ones, and
no other name clashes.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, table, text_or_empty

CAPACITY = 4096
#: Groups that the pieces of one length are ranked in, at least, and pieces in all for which there is one more.
SALTS, SALT_ROWS = 128, 1 << 20
#: Bytes of text that a worker encodes at a time.
BATCH_BYTES = 8 << 20
#: Latin letters (all but U+0130, whose small form is two characters) and the ASCII punctuation after them, in RE2.
SUFFIXED = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-\x{012F}\x{0131}-\x{024F}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: What may be lowered neither alone nor in a text, and how special tokens of the vocabulary begin.
BEYOND, SPECIAL = r"[\x{0130}\x{0250}-\x{10FFFF}]", "<|"

Pattern = tuple[int, list[tuple[int, int]]]  # how many bins, and in each (length, copies)


class WordMerges:
    """BPE merges of many plain words at once, one merge of every word a round.

    Merges, vocabulary and word-end mark are those of the ``tokenizers`` file; each
    word's lowest-ranked pair (the leftmost of equals) is merged in each round, so
    ids come out as from the library.  It is for words of Latin letters, which its
    normaliser only lowers and its pre-tokeniser leaves whole.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            model = json.load(lines)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # how byte-level BPE writes bytes
        self.inner = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letter[b] + end] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[x] << 17 | vocab[y] for x, y in pairs], dtype=np.int64)
        by = np.argsort(key, kind="stable")
        self.key, self.rank = key[by], by.astype(np.int32)
        self.into = np.array([vocab[x + y] for x, y in pairs], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 17 | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], self.NONE)

    def __call__(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has; no word is empty."""
        ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
        flat = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        size = np.diff(ends)
        sym, word = self.inner[flat], np.repeat(np.arange(len(words), dtype=np.int32), size)
        last = np.cumsum(size) - 1
        sym[last] = self.final[flat[last]]
        done_sym, done_word = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)]
        rank = np.full(len(sym), self.NONE)
        if len(sym) > 1:
            inside = word[:-1] == word[1:]
            rank[:-1][inside] = self._ranks(sym[:-1][inside], sym[1:][inside])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.concatenate([starts, [len(sym)]]))
            least = np.minimum.reduceat(rank, starts)
            done = least == self.NONE
            if done.any():
                left = ~np.repeat(done, length)
                done_sym.append(sym[~left])
                done_word.append(word[~left])
                sym, word, rank, length, least = sym[left], word[left], rank[left], length[~done], least[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
            sym[hit] = self.into[rank[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # places once the merged symbols are gone
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched] = self.NONE
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self._ranks(sym[touched], sym[touched + 1])
        word = np.concatenate(done_word)
        return np.concatenate(done_sym)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class BatchTokenizer:
    """Ids of many whole texts at once; each different unit of a batch is encoded once.

    A unit is what stands between single spaces or line feeds, which the
    normaliser and pre-tokeniser never see across.  Texts of Latin letters are
    lowered at once (not where they may hold a special token, whose case counts).
    Latin letters followed by ASCII punctuation are two tokens of the
    pre-tokeniser, so ``word``, ``Word`` and ``word,`` share the merges of the
    letters; punctuation and any other unit are the library's.  Nothing is kept
    between batches.
    """

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "tokenizer": None}

    def _ready(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.words = WordMerges(self.path)

    def _library(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, dtype=np.int64) for e in self.tokenizer.encode_batch_fast(units.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.empty(0, dtype=np.int64), *ids]), np.array([len(i) for i in ids], dtype=np.int64)

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (none null) end to end as unsigned 32-bit integers, and where each text begins and ends."""
        if self.tokenizer is None:
            self._ready()
        plain = pc.invert(pc.or_(pc.match_substring(texts, SPECIAL), pc.match_substring_regex(texts, BEYOND)))
        lowered = pc.if_else(plain, pc.utf8_lower(texts), texts)
        lists = pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        units, place = coded.dictionary, coded.indices.to_numpy()
        cut = pc.extract_regex(units, SUFFIXED)
        whole = cut.is_valid().to_numpy(zero_copy_only=False)
        words, tails = (pc.utf8_lower(cut.field(i).filter(pa.array(whole))).dictionary_encode() for i in (0, 1))
        parts = [self.words(words.dictionary), self._library(tails.dictionary), self._library(units.filter(pa.array(~whole)))]
        # Every unit is two runs of the pool: letters and punctuation, or all of it and nothing.
        pool, runs = np.concatenate([p for p, _ in parts]), np.concatenate([*(n for _, n in parts), [0]])
        w, t = len(words.dictionary), len(tails.dictionary)
        first, second = np.empty(len(units), dtype=np.int64), np.full(len(units), len(runs) - 1)
        first[whole], second[whole] = words.indices.to_numpy(), w + tails.indices.to_numpy()
        first[~whole] = w + t + np.arange(len(units) - len(words))
        run = np.column_stack([first, second])[place].ravel()
        length = runs[run]
        ends = np.concatenate([[0], np.cumsum(length)])
        begin = (np.cumsum(runs) - runs)[run]
        ids = pool[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids.astype("<u4"), ends[2 * bounds]


def batches_of(texts: pa.StringArray) -> Iterator[tuple[int, pa.StringArray]]:
    """Slices of about ``BATCH_BYTES``, with their first place; a longer text is a slice of its own."""
    number = (np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) - 1) // BATCH_BYTES
    starts = [*np.flatnonzero(np.diff(number, prepend=-2)).tolist(), len(texts)]
    for at, end in zip(starts[:-1], starts[1:], strict=True):
        yield at, texts[at:end]


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces ``(id_col, piece, start, length, ids_crc32, ids)`` of at most ``capacity`` tokens; only longer documents are cut.

    ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(BatchTokenizer(tokenizer_path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in batches_of(batch.column(1)):
                yield pieces_of(batch.column(0)[at : at + len(texts)], *shared.value(texts))

    def pieces_of(keys: pa.Array, flat: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        rows, piece, start, length, crc, values = [], [], [], [], [], []
        for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            ids = np.append(flat[a:b], np.uint32(end_id))
            for number, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                rows.append(row)
                piece.append(number)
                start.append(at)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
                values.append(part)
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]).astype(np.int32)
        ids = np.concatenate([np.empty(0, dtype="<u4"), *values]).view("<i4")
        columns = [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
        return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "ids"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(cut, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>").withColumnRenamed("id", id_col)


class Lengths:
    """The pieces still to place: counts by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: c for s, c in counts.items() if c}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, room: int, without: int | None = None) -> int | None:
        """Largest length of at most ``room``; one piece of length ``without`` is in use."""
        at = bisect_left(self.sizes, room + 1) - 1
        if at >= 0 and self.sizes[at] == without and self.counts[without] < 2:
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def smallest_sum(self, n: int, without: int) -> float:
        """Sum of the ``n`` smallest pieces other than one of length ``without``."""
        total, left = 0, n
        for size in self.sizes:
            have = min(left, self.counts[size] - (size == without))
            total, left = total + have * size, left - have
            if not left:
                return total
        return float("inf")

    def pairs(self, room: int, without: int) -> tuple[int, int]:
        """Over pairs that fit ``room``: the largest sum, and the largest of their smaller parts (0: none)."""
        best = least = 0
        sizes, hi = self.sizes, len(self.sizes) - 1
        have = lambda s: self.counts[s] - (s == without)
        for lo, small in enumerate(sizes):
            if 2 * small > room:
                break
            while hi > lo and (sizes[hi] + small > room or not have(sizes[hi])):
                hi -= 1
            if have(small) and (hi > lo or have(small) > 1):
                best, least = max(best, small + sizes[max(hi, lo)]), small
        return best, least


def dominating_set(left: Lengths, size: int, capacity: int) -> list[int] | None:
    """Lengths to put beside a piece of ``size`` in a bin that dominates all its others, if one is known.

    A set dominates another when the other's pieces can be grouped so that each
    group is no longer than a piece of the set of its own.
    """
    room = capacity - size
    best = left.largest(room, size)
    if best is None:
        return []
    if best == room or left.smallest_sum(2, size) > room:
        return [best]  # a perfect fit, or only one more piece fits
    if left.smallest_sum(3, size) <= room:
        return None
    total, least = left.pairs(room, size)
    if best >= total:
        return [best]  # no two pieces together are longer
    rest = left.largest(room - best, size)
    if rest is not None and rest >= least and best + rest <= room and (rest != best or left.counts[best] - (best == size) > 1):
        return [best, rest]  # either part of any pair is matched
    return None


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], Lengths]:
    """Fix dominating sets until none is left; returns the fixed bins and the shrunk instance."""
    left, fixed, changed = Lengths(counts), [], True
    while changed:
        changed = False
        for size in reversed(left.sizes.copy()):
            while size in left.counts and (beside := dominating_set(left, size, capacity)) is not None:
                used = {s: beside.count(s) + (s == size) for s in {size, *beside}}
                n = min(left.counts[s] // k for s, k in used.items())
                if not n:
                    break
                for s, k in used.items():
                    left.take(s, n * k)
                fixed.append((n, sorted(used.items(), reverse=True)))
                changed = True
    return fixed, left


def best_fit(left: Lengths, capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit, longest first, over counts: equal bins are kept together."""
    open_bins: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, group: Pattern) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append(group)

    for size in reversed(left.sizes):
        n = left.counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, bins, runs = capacity, max(1, n // (capacity // size)), []
            else:
                room = rooms[at]
                bins, runs = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            each = min(room // size, n)
            full = min(bins, n // each)
            put(room - each * size, (full, [*runs, (size, each)]))
            n -= full * each
            if bins > full:
                put(room, (bins - full, runs))
    return [group for groups in open_bins.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where pieces go: by length and rank among its equals, arrays sorted by ``key`` = length and first rank."""
    fixed, left = reduce_instance(counts, capacity)
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, runs in fixed + best_fit(left, capacity):
        offset = 0
        for size, each in runs:
            first = seen.get(size, 0)
            rows.append((size, first, sequence, each, offset))
            seen[size] = first + bins * each
            offset += size * each
        sequence += bins
    if seen != {s: c for s, c in counts.items() if c}:
        raise AssertionError("the plan does not place every piece once")
    rows.sort()
    size, first, base, each, offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return {"size": size, "first": first, "base": base, "each": each, "offset": offset}


def pack(pieces: DataFrame, key_cols: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    ``key_cols`` order the pieces; rows that agree in all of them may trade places.
    Groups are dealt by all columns, so pieces without an id are spread out too.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    salt = F.pmod(F.xxhash64(*keep), F.lit(max(SALTS, pieces.count() // SALT_ROWS))).cast("int")
    rows = pieces.select(F.struct(*keep).alias("row"), F.col(length_col).cast("long").alias("len"), salt.alias("salt"))
    groups = rows.groupBy("len", "salt").count()
    counts = {r["len"]: r["n"] for r in groups.groupBy("len").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    before = "sum(count) OVER (PARTITION BY len ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = groups.selectExpr("len", "salt", f"coalesce({before}, 0) AS base")
    order = ", ".join(f"row.`{c}`" for c in key_cols)
    ranked = rows.withColumn("rn", F.expr(f"row_number() OVER (PARTITION BY len, salt ORDER BY {order}) - 1"))

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        p, size, r = shared.value, length.to_numpy(), rank.to_numpy()
        wide = np.int64(1) << 44  # ranks stay below it
        at = np.searchsorted(p["size"] * wide + p["first"], size * wide + r, side="right") - 1
        into, copy = np.divmod(r - p["first"][at], p["each"][at])
        return pa.StructArray.from_arrays([pa.array(p["base"][at] + into), pa.array(p["offset"][at] + copy * size)], ["sequence_id", "offset"])

    placed = ranked.join(bases, ["len", "salt"]).withColumn("at", place("len", F.col("base") + F.col("rn")))
    return placed.select("row.*", "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = token_pieces(docs, tokenizer_path).drop("ids")
    return pack(materialize(pieces, "pieces"), ["doc_id", "piece"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
