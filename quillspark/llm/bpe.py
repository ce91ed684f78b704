"""Byte-level BPE encoding and decoding.

Two tiers.  A minimal perfect hash over the vocabulary answers whole pre-tokens
that are entries already; every miss is merged by a heap over a doubly linked
list of bytes, lowest rank first and leftmost on ties.  The tables are built on
the driver from the rank file (bounded by the vocabulary) and broadcast.

Nulls encode as the empty text; an empty text gives no ids; texts of any length
are encoded whole.  Repeated rows stay repeated rows, and an empty table gives no
rows.  Columns of the input that clash with an output column are replaced by it.
"""

from __future__ import annotations

import base64
import heapq
import struct
from array import array
from collections.abc import Callable
from string import ascii_letters

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import table, text_or_empty, unused

#: Pre-tokens remembered per Python worker; the memory is emptied when full, which changes no result.
MEMO_ENTRIES = 800_000
#: Longer pieces are not remembered, so the memory stays bounded.
MEMO_CHARS = 40
#: One id, packed.
ID = struct.Struct("<i").pack
#: Modulus of the displaced slots, before they are reduced to the table's size.
PRIME = (1 << 31) - 1


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries in rank order from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash from ``n`` byte strings onto ``0..n-1`` slots, by displaced buckets.

    Keys fall into ``n / 2`` buckets; the largest buckets pick first a
    displacement that sends all their keys to free slots.  Buckets of one key
    store their slot directly, as a negative displacement, which makes the hash
    minimal.  ``rank`` compares the stored bytes, so strangers are told apart.
    """

    def __init__(self, keys: list[bytes]):
        self.size = n = len(keys)
        self.buckets = max(1, n // 2)
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.ranks = [-1] * n
        filed: dict[int, list[tuple[int, int, int]]] = {}
        for rank, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            filed.setdefault(h % self.buckets, []).append(((h >> 32) & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFFF, rank))
        taken = bytearray(n)
        singles = []
        for bucket, members in sorted(filed.items(), key=lambda item: -len(item[1])):
            if len(members) == 1:
                singles.append((bucket, members[0][2]))
                continue
            step = 0
            while True:
                slots = [(a + step * b) % PRIME % n for a, b, _ in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                step += 1
                if step > 64 * n:
                    raise ValueError("two vocabulary entries share a hash")
            self.shift[bucket] = step
            for slot, (_, _, rank) in zip(slots, members, strict=True):
                taken[slot], self.keys[slot], self.ranks[slot] = 1, keys[rank], rank
        free = (s for s in range(n) if not taken[s])
        for bucket, rank in singles:
            slot = next(free)
            self.shift[bucket], self.keys[slot], self.ranks[slot] = -slot - 1, keys[rank], rank

    def rank(self, token: bytes) -> int:
        """The entry's rank, or -1."""
        if not self.size:
            return -1
        h = xxhash.xxh3_128_intdigest(token)
        step = self.shift[h % self.buckets]
        slot = -step - 1 if step < 0 else (((h >> 32) & 0xFFFFFFFF) + step * ((h >> 64) & 0xFFFFFFFF)) % PRIME % self.size
        return self.ranks[slot] if self.keys[slot] == token else -1


def pair_ranks(entries: list[bytes], rank: Callable[[bytes], int]) -> dict[int, int]:
    """Rank of every entry that two entries spell together, under ``left << 32 | right``."""
    pairs = {}
    for whole, entry in enumerate(entries):
        for cut in range(1, len(entry)):
            left = rank(entry[:cut])
            if left >= 0 and (right := rank(entry[cut:])) >= 0:
                pairs[left << 32 | right] = whole
    return pairs


def merge_bytes(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of a piece that is no entry itself: best merges first, over linked bytes.

    ``ids`` are the ids of its single bytes.  A node is known by the place of its
    first byte; ``after`` and ``before`` link the nodes that are left.  The heap
    holds ``rank << 32 | place``, so the lowest rank comes first and the leftmost
    of equals; ``best`` is the rank a node and the next spell now, which tells
    entries that an earlier merge has made stale.
    """
    n = len(ids)
    if n < 2:
        return ids
    get, push, pop = pairs.get, heapq.heappush, heapq.heappop
    best = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
    heap = [r << 32 | i for i, r in enumerate(best) if r >= 0]
    heapq.heapify(heap)
    best.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = pop(heap)
        r, i = top >> 32, top & 0xFFFFFFFF
        if best[i] != r:
            continue
        j = after[i]
        after[i] = k = after[j]
        ids[i], best[j] = r, -1
        if k < n:
            before[k] = i
            best[i] = s = get(r << 32 | ids[k], -1)
            if s >= 0:
                push(heap, s << 32 | i)
        else:
            best[i] = -1
        h = before[i]
        if h >= 0:
            best[h] = s = get(ids[h] << 32 | r, -1)
            if s >= 0:
                push(heap, s << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern.

    A space between two visible characters always begins a pre-token, so texts
    are cut there first and whole units are remembered; this changes no id.  It
    holds for patterns whose matches have white space only at their front or
    throughout, as byte-level BPE patterns do.
    """

    def __init__(self, entries: list[bytes], pattern: str):
        self.entries, self.pattern, self.hash = entries, pattern, PerfectHash(entries)
        self.pairs = pair_ranks(entries, self.hash.rank)
        self.bytes = [self.hash.rank(bytes([b])) for b in range(256)]
        if -1 in self.bytes:
            raise ValueError("the vocabulary lacks single bytes")
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.words = self.find(f" {ascii_letters}") == [f" {ascii_letters}"]  # letters after a space are one piece
        self.blank_run = regex.compile(r"\s\s|^\s|\s$").search
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.memo: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("entries", "pattern", "hash", "pairs", "bytes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def piece_ids(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.hash.rank(raw)
        return ID(whole) if whole >= 0 else array("i", merge_bytes([*map(self.bytes.__getitem__, raw)], self.pairs)).tobytes()

    def unit_ids(self, unit: str) -> bytes:
        """Ids, packed, of a unit and the space before it; its pieces are remembered as units where they are such."""
        if self.words and unit.isascii() and unit.isalpha():
            return self.piece_ids(" " + unit)
        memo, pieces = self.memo, self.find(" " + unit)
        if len(pieces) == 1:
            return self.piece_ids(pieces[0])
        parts = []
        for piece in pieces:
            key = piece[1:] if piece[0] == " " else None
            ids = memo.get(key) if key else None
            if ids is None:
                ids = self.piece_ids(piece)
                if key and len(piece) < MEMO_CHARS:
                    self.remember(key, ids)
            parts.append(ids)
        return b"".join(parts)

    def remember(self, unit: str, ids: bytes) -> None:
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[unit] = ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        memo, units = self.memo, self.cut(text) if self.blank_run(text) else text.split(" ")
        parts = [self.piece_ids(piece) for piece in self.find(units[0])]
        del units[0]
        found = [*map(memo.get, units)]
        if None in found:
            for at, unit in enumerate(units):
                if found[at] is None:
                    ids = memo.get(unit)
                    if ids is None:
                        ids = self.unit_ids(unit)
                        if len(unit) < MEMO_CHARS:
                            self.remember(unit, ids)
                    found[at] = ids
        return np.frombuffer(b"".join(parts + found), dtype="<i4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


def encode_documents(docs: DataFrame, codec: Codec, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Add ``ids_col``, the array of token ids of the whole text.

    With ``decoded_col`` the ids are decoded where they were made, too, which
    spares a second Python worker in each task and sending the ids to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    if decoded_col is None:

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def ids_of(texts: pa.Array) -> pa.Array:
            encode = shared.value.encode
            return id_lists([encode(text.as_py()) for text in texts])

        return docs.withColumn(ids_col, ids_of(text_or_empty(text_col)))

    @F.arrow_udf(T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType()))
    def both_of(texts: pa.Array) -> pa.Array:
        encode, decode, ids, decoded = shared.value.encode, shared.value.decode, [], []
        for text in texts:
            ids.append(encode(text.as_py()))
            decoded.append(decode(ids[-1].tolist()))
        return pa.StructArray.from_arrays([id_lists(ids), pa.array(decoded, pa.binary())], ["ids", "decoded"])

    both, kept = unused(docs, "both"), [c for c in docs.columns if c.lower() not in (ids_col.lower(), decoded_col.lower())]
    made = docs.withColumn(both, both_of(text_or_empty(text_col)))
    return made.select(*kept, F.col(f"{both}.ids").alias(ids_col), F.col(f"{both}.decoded").alias(decoded_col))


def id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *rows])))


def decode_ids(docs: DataFrame, codec: Codec, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the bytes that the ids stand for (null ids: no bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    @F.arrow_udf(T.BinaryType())
    def bytes_of(rows: pa.Array) -> pa.Array:
        decode, values, ends = shared.value.decode, rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
        return pa.array([decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return docs.withColumn(out_col, bytes_of(F.coalesce(ids_col, F.array().cast("array<int>"))))


def public_codec(name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(read_ranks(path or public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both sides."""
    codec = public_codec()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, codec, decoded_col="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
