"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is
deleted.  The key is the 64-bit hash of that normal form.  A directory over the
leading key bits doubles until no bucket holds more than ``capacity`` different
keys, to any depth: its first depth follows the number of keys, and buckets that are
overfull there are split deeper, alone.  A bucket is a contiguous key range, named by
the key it begins with, and a key finds its bucket from its own bits and the tables of
overfull buckets (empty as a rule), so no list of buckets is held anywhere.  Each range
has one owner task, which walks its rows in key order, chains the texts of a key, tells
chain members apart by comparing bytes, and writes its part of the index into the
shared folder.  Copies met in the same input batch are folded into one head
before the shuffle, so a text that makes up a third of the table reaches its
owner as one row per batch.

Null texts count as empty, and empty texts equal each other.  Of equal texts the
row with the most code points in the original stays, then the smallest id; null
ids lose ties.  Repeated rows are separate rows of the result, and exactly one row
of a class is kept, also where rows tie or the winner has no id.  An empty table
gives an empty result; extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table, text_or_empty

MEMBER = "struct<id: bigint, chars: bigint>"
#: Overfull buckets of a depth that are broadcast at most (8 bytes each).
BROADCAST_BUCKETS = 1 << 16


def normal_form(text_col: str = "text"):
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", "")


@dataclass
class Directory:
    """Depths, first to last, and for each but the last the buckets ``start`` that are overfull there, with their number."""

    depths: list[int]
    overfull: list[tuple[DataFrame, int]]


def _start(depth: int) -> Column:
    """Where the bucket of a key begins at a depth: the key with its further bits cleared."""
    if depth == 0:
        return F.lit(0).cast("long")
    return F.col("key") if depth >= 64 else F.shiftleft(F.shiftrightunsigned("key", 64 - depth), 64 - depth)


def directory(keys: DataFrame, capacity: int, step: int = 4) -> Directory:
    """The directory of a table of ``key``s: overfull buckets are counted ``step`` bits deeper, until there are none."""
    left = keys = materialize(keys.select("key").distinct(), "keys")
    found = Directory([min(64, (keys.count() // capacity).bit_length() + 1)], [])
    while True:
        depth = found.depths[-1]
        held = left.groupBy(_start(depth).alias("start")).agg(F.count("*").alias("n"))
        full = materialize(held.where(F.col("n") > capacity).select("start"), "overfull")
        n = full.count()
        if not n:
            return found
        left = left.join(full, _start(depth) == full["start"], "left_semi")
        found.overfull.append((full, n))
        found.depths.append(min(64, depth + step))


def with_bucket(rows: DataFrame, found: Directory) -> DataFrame:
    """Rows with ``bucket``, where the bucket of their ``key`` begins."""
    rows = rows.withColumn("bucket", _start(found.depths[0]))
    for (full, n), deeper in zip(found.overfull, found.depths[1:], strict=True):
        split = full.withColumnRenamed("start", "split")
        split = F.broadcast(split) if n <= BROADCAST_BUCKETS else split
        rows = rows.join(split, F.col("bucket") == F.col("split"), "left").withColumn("bucket", F.when(F.col("split").isNotNull(), _start(deeper)).otherwise(F.col("bucket"))).drop("split")
    return rows


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the equal texts of a batch into one head with its members."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("bucket", "key", "id", "chars"))
        members: dict[tuple[int, int, bytes], list[dict]] = {}
        for norm, bucket, key, i, n in zip(batch.column("norm").cast(pa.binary()).to_pylist(), *columns, strict=True):
            members.setdefault((bucket, key, norm), []).append({"id": i, "chars": n})
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _, _ in members], pa.int64()),
                pa.array([k for _, k, _ in members], pa.int64()),
                pa.array([t for _, _, t in members], pa.binary()),
                pa.array(list(members.values()), pa.list_(pa.struct([("id", pa.int64()), ("chars", pa.int64())]))),
            ],
            ["bucket", "key", "norm", "members"],
        )


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk heads in key order: place each in the chain of its key, by its bytes."""
    now, links = None, {}
    for batch in batches:
        place, digest = [], []
        for key, norm in zip(batch.column("key").to_pylist(), batch.column("norm").to_pylist(), strict=True):
            if key != now:
                now, links = key, {}
            if norm not in links:
                links[norm] = (len(links), hashlib.sha256(norm).hexdigest())
            at, sha = links[norm]
            place.append(at)
            digest.append(sha)
        yield pa.RecordBatch.from_arrays(
            [batch.column("bucket"), batch.column("key"), pa.array(place, pa.int32()), pa.array(digest, pa.string()), batch.column("members")],
            ["bucket", "key", "link", "sha256", "members"],
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, key_bits: int = 64) -> DataFrame:
    """Index rows ``(bucket, key, link, sha256, id, chars, row)``, one per input row, from shared files.

    ``(key, link)`` names a class of equal texts, ``row`` a row.  ``key_bits`` below
    64 coarsens the hash, which only makes chains longer.
    """

    def key_of(norm: Column) -> Column:
        key = F.xxhash64(norm)
        return key if key_bits >= 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)

    norm = normal_form(text_col)
    found = directory(docs.select(key_of(norm).alias("key")), capacity)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.length(text_or_empty(text_col)).cast("long").alias("chars"), norm.alias("norm")).withColumn("key", key_of(F.col("norm")))
    heads = with_bucket(rows, found).mapInArrow(_heads, f"bucket bigint, key bigint, norm binary, members array<{MEMBER}>")
    owned = heads.repartition("bucket").sortWithinPartitions("bucket", "key")
    index = owned.mapInArrow(_own, f"bucket bigint, key bigint, link int, sha256 string, members array<{MEMBER}>")
    members = index.select("bucket", "key", "link", "sha256", F.explode("members").alias("m")).select("bucket", "key", "link", "sha256", "m.id", "m.chars")
    return materialize(members.withColumn("row", F.monotonically_increasing_id()), "hash-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index_options) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``."""
    index = build_index(docs, id_col, text_col, **index_options)
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row")))
    classes = index.groupBy("key", "link").agg(F.count("*").alias("group_size"), best.alias("best"))
    many = classes.where("group_size > 1").select("key", "link", "group_size", "best.keep_id", "best.keep_row")
    many = materialize(many, "classes")  # so that the join has a shuffle of its own, which may be split where a class is hot
    rows = index.join(many, ["key", "link"], "left")
    shared = F.col("keep_row").isNotNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.when(shared, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(shared, F.col("row") == F.col("keep_row")).otherwise(True).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY n.norm ORDER BY n.chars DESC, n.doc_id) = 1 AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
