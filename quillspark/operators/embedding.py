"""Batches of texts for an embedding service, and its replies put in order and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: texts of a request at most.
BATCH = 96


def embedding_batches(rows: DataFrame, key: str, order_col: str, size: int = BATCH) -> DataFrame:
    """Adds ``batch`` and ``index``, the place in it, in order within each key, whose rows one task numbers."""
    numbered = rows.withColumn("__n", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY {order_col}) - 1"))
    return numbered.withColumns({"batch": F.floor(F.col("__n") / size), "index": F.col("__n") % size}).drop("__n")


def embedded(requests: DataFrame, replies: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """Requests with their embedding, matched by batch and index in whatever order replies come.

    The job fails on an index that was not asked for, one that is answered twice or
    not at all, and on an embedding of another width.
    """
    found = replies.groupBy(*keys, "batch", "index").agg(F.count("*").alias("__answers"), F.any_value("embedding").alias("embedding"))
    both = requests.withColumn("__asked", F.lit(True)).join(found, [*keys, "batch", "index"], "full")
    wrong = (
        F.when(F.col("__asked").isNull(), F.concat(F.lit("index out of range: "), F.col("index").cast("string")))
        .when(F.col("__answers").isNull(), F.concat(F.lit("no embedding for input "), F.col("index").cast("string")))
        .when(F.col("__answers") > 1, F.concat(F.lit("duplicate index "), F.col("index").cast("string")))
        .when(F.size("embedding") != dims, F.concat(F.lit("dimension mismatch: "), F.size("embedding").cast("string")))
    )
    return both.withColumn("embedding", F.when(wrong.isNull(), F.col("embedding")).otherwise(F.raise_error(wrong))).drop("__asked", "__answers")
