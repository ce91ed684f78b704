"""Connected components by alternating large-star and small-star steps.

Every step is one aggregate (with map-side combine, so a hot node never gathers
its neighbours in one task) and one join (which adaptive execution may split
when a node is hot).  Edges are written to the shared folder each round, so the
loop survives lost executors and the driver only sees one counter per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node of their neighbourhood.

    ``large`` links neighbours above the node, otherwise those below it.
    """
    rows = _both_ways(edges)
    if not large:
        rows = rows.where("v < u")
    low = rows.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("m"))
    linked = rows.join(low, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = low.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(own).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` with root the smallest node of the component.

    Self loops and null ends are ignored, so isolated nodes do not appear.  An
    empty table gives an empty result.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = materialize(_star(_star(now, large=True), large=False), "edges")
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
