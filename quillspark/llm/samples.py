"""Labelled training rows, bounded and never from the held-out third."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import is_held_out

#: Labelled documents a model is fitted on, about and at most by the share that a hash picks.
SAMPLE_ROWS = 40_000
_PARTS = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, label)`` of about ``rows`` labelled documents that are not held out.

    The rows are those whose id hashes lowest, so the choice does not depend on
    order or partitioning.  Null labels are left out; of contradicting labels of
    one id the larger counts.  The id list is broadcast: ``rows`` bounds it.
    """
    known = labels.where(~is_held_out(id_col)).select(F.col(id_col).alias("id"), label.alias("label")).where("label is not null").groupBy("id").agg(F.max("label").alias("label"))
    share = F.pmod(F.xxhash64("id"), F.lit(_PARTS))
    cut = min(_PARTS, _PARTS * rows // max(1, known.count()))
    picked = known.where(share < cut)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "id").select("text", "label")


def without_near_copies(sample: DataFrame, words: int = 5) -> DataFrame:
    """One ``(text, label)`` row of those that share a min-hash of their word shingles.

    Two hashes are tried in turn, so hardly a near copy is left.  Counts over a
    sample then tell how often something was written, not how often it was copied.
    Of several rows that with the smallest hash of its text stays, then the larger
    label, so every run keeps the same ones.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sketch(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            units = text.as_py().encode().split()
            grams = map(b" ".join, zip(*(units[i:] for i in range(words)), strict=False)) if len(units) >= words else [b" ".join(units)]
            h = np.array([zlib.crc32(g) for g in grams], dtype=np.uint64)
            rows.append([int(h.min()), int((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).min())])
        return pa.array(rows, pa.list_(pa.int64()))

    kept = sample.withColumn("sketch", sketch("text"))
    for i in (0, 1):
        first = F.min(F.struct(F.xxhash64("text").alias("hash"), (-F.col("label")).alias("less"), "text", "label", "sketch"))
        kept = kept.groupBy(F.get("sketch", F.lit(i)).alias("key")).agg(first.alias("r")).select("r.*")
    return kept.select("text", "label")
