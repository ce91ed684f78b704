"""Helpers the training-data operators share: tables, checkpoints, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.shared import materialize, scratch_path, spread

__all__ = ["is_held_out", "materialize", "scratch_path", "table", "text_or_empty", "unused"]


#: Tables of texts, on which work takes much longer than reading does.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def text_or_empty(name: str = "text") -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def is_held_out(id_col: str = "doc_id") -> Column:
    """The fixed split: crc32 of the id as text, modulo 3, equals 1 (null ids are held out)."""
    part = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    return F.coalesce(part == 1, F.lit(True))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it as long as the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
