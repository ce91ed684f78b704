"""Connected components by alternating large-star and small-star steps.

A step is one aggregate, combined before its shuffle so a hot node never gathers its
neighbours, and one join, which adaptive execution may split.  Rounds grow with the
logarithm of the longest chain; edges are written to the shared folder each round, and
the driver sees one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.shared import materialize


def _linked(edges: DataFrame, above: bool) -> DataFrame:
    """Edges from neighbours (those above a node, or all below it and the node) to the smallest of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if above else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = near.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"), (F.col("v") > F.col("u")).alias("is_above"))
    if above:
        return met.where("is_above and u <> v").select("u", "v").distinct()
    return met.where("u <> v").select("u", "v").unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)``, root being the smallest node that links lead to.

    Self loops and null ends are ignored, so lone nodes don't appear; an empty table gives no rows.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = materialize(_linked(_linked(now, True), False), "links")
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
