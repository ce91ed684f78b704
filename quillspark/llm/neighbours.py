"""Approximate nearest neighbours by collision counting over projections.

Vectors are dealt into blocks of bounded size.  A block and the queries that meet it
go to one task, the block first: each of ``projections`` random directions gives one
sorted array of its projected values, and the queries stream past, so an index never
moves.  A query opens a window around its own value in every array and widens all of
them step by step
(virtual rehashing: no table is built anew).  A vector that lies in the windows of
at least ``threshold`` of the directions is verified: its distance is computed on
the original vectors in double precision.  Widening stops when a vector as near as
the k-th best would have been missed with a probability of at most ``miss`` - or
when every vector is verified.  There is no cap on candidates.

A query first meets one block.  The k-th distance found there bounds the search in
all others, where windows need not open further for it and only vectors within it
are returned; each query's results are merged at the end.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id; vectors of different lengths never meet.  Queries with
the same id are one (the least vector of them); candidates with the query's id
are its own; repeated candidate rows are found as often as they occur.  Equal
distances rank by id.  An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

PROJECTIONS, THRESHOLD, MISS = 64, 36, 0.03
BLOCK_ROWS = 8192
#: Factor by which windows widen, and queries of a block that widen them together.
GROWTH, TOGETHER = 1.2, 64
SEED = 7


def missed(distance: float, width: float, projections: int, threshold: int) -> float:
    """Chance that a vector at ``distance`` lies in fewer than ``threshold`` windows of half-width ``width``."""
    if distance <= 0:
        return 0.0
    p = erf(width / distance / sqrt(2))
    return sum(comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(threshold))


def stopping_ratio(projections: int, threshold: int, miss: float) -> float:
    """Smallest width, in units of the distance, at which a miss is unlikely enough."""
    low, high = 0.0, 64.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if missed(1.0, mid, projections, threshold) <= miss else (mid, high)
    return high


def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, projections))


def project(vectors: np.ndarray, projections: int = PROJECTIONS) -> tuple[np.ndarray, np.ndarray]:
    """For every direction, the projected values in order and the vectors they belong to."""
    projected = (vectors @ directions(vectors.shape[1], projections)).T
    order = np.argsort(projected, axis=1).astype(np.int32)
    return np.take_along_axis(projected, order, axis=1), order


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, values: np.ndarray, order: np.ndarray, threshold: int = THRESHOLD, miss: float = MISS):
        self.vectors, self.ids, self.values, self.order, self.threshold = vectors, ids, values, order, threshold
        self.directions = directions(vectors.shape[1], len(values))
        self.ratio = stopping_ratio(len(values), threshold, miss)
        self.spread = max(1e-9, float(np.median(np.linalg.norm(vectors - vectors.mean(axis=0), axis=1))))

    def windows(self, centres: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the windows of every query (row) in every array (column)."""
        low = np.column_stack([np.searchsorted(a, c - width) for a, c in zip(self.values, centres.T, strict=True)])
        high = np.column_stack([np.searchsorted(a, c + width, side="right") for a, c in zip(self.values, centres.T, strict=True)])
        return low, high

    def search(self, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every query, ids and distances of at most ``k`` vectors: the nearest verified ones within its bound, not its own."""
        for start in range(0, len(queries), TOGETHER):
            part = slice(start, start + TOGETHER)
            yield from self._widen(queries[part], query_ids[part], bounds[part], k)

    def _widen(self, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, m = len(self.vectors), len(self.values)
        centres = queries @ self.directions
        counts = np.zeros((len(queries), n), dtype=np.int16)
        far = np.full((len(queries), n), np.inf)  # inf: not verified
        own = self.ids == query_ids[:, None]
        todo = n - own.sum(axis=1)
        kth = bounds.copy()
        width = np.minimum(self.spread, bounds) * self.ratio / GROWTH**2
        left = right = np.column_stack([np.searchsorted(a, c) for a, c in zip(self.values, centres.T, strict=True)])
        left, right = left.copy(), right.copy()
        active = np.flatnonzero(todo)
        while len(active):
            low, high = self.windows(centres[active], width[active])
            low, high = np.minimum(low, left[active]), np.maximum(high, right[active])
            for row, q in enumerate(active.tolist()):
                fresh = [self.order[j, a:b] for j, a, b in zip(range(m), low[row].tolist(), left[q].tolist(), strict=True) if a < b]
                fresh += [self.order[j, a:b] for j, a, b in zip(range(m), right[q].tolist(), high[row].tolist(), strict=True) if a < b]
                if fresh:
                    counts[q] += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
                new = np.flatnonzero((counts[q] >= self.threshold) & np.isinf(far[q]) & ~own[q])
                if len(new):
                    far[q, new] = np.sqrt(((self.vectors[new] - queries[q]) ** 2).sum(axis=1))
                    todo[q] -= len(new)
                    if n - int(own[q].sum()) - todo[q] >= k:
                        kth[q] = min(bounds[q], np.partition(far[q], k - 1)[k - 1])
            left[active], right[active] = low, high
            active = active[(todo[active] > 0) & (width[active] < kth[active] * self.ratio)]
            # The last step goes no further than it has to.
            width[active] = np.minimum(width[active] * GROWTH, np.maximum(kth[active] * self.ratio, width[active]))
        out = []
        for q in range(len(queries)):
            some = np.flatnonzero(np.isfinite(far[q]) & (far[q] <= bounds[q]))
            best = some[np.lexsort((self.ids[some], far[q, some]))[:k]]
            out.append((self.ids[best], far[q, best]))
        return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(rows: list[pa.Array]) -> np.ndarray:
    return np.concatenate([r.flatten().to_numpy() for r in rows]).reshape(sum(map(len, rows)), -1).astype(np.float64)


def _search_blocks(batches: Iterator[pa.RecordBatch], k: int, projections: int) -> Iterator[pa.RecordBatch]:
    """Rows of block after block, its vectors before its queries: index the vectors, then answer queries as they come."""
    now, ids, vectors, index = None, [], [], None
    for batch in batches:
        keys = [*zip(batch.column("dim").to_pylist(), batch.column("part").to_pylist(), batch.column("asks").to_pylist(), strict=True)]
        ends = [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for start, end in zip([0, *ends], ends, strict=False):
            (dim, part, asks), rows = keys[start], batch.slice(start, end - start)
            if now != (dim, part):
                now, ids, vectors, index = (dim, part), [], [], None
            if not asks:
                ids.append(rows.column("id").to_numpy())
                vectors.append(rows.column("vector"))
                continue
            if not vectors:
                continue  # no vector fell into this block
            if index is None:
                data = _matrix(vectors)
                index = CollisionIndex(data, np.concatenate(ids), *project(data, projections))
            asked, bounds = rows.column("id").to_numpy(), np.nan_to_num(rows.column("bound").to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf)
            found = [*index.search(_matrix([rows.column("vector")]), asked, bounds, k)]
            q = np.repeat(asked, [len(v) for v, _ in found])
            v, d = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(d)], ["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, projections: int = PROJECTIONS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query row."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asked = rows.where("asks").groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("q")).select("id", "q.vector", "q.dim")
    counts = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int").alias("parts"))  # a row per vector length
    place = lambda df: df.join(F.broadcast(counts), "dim").withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int"))
    none = F.lit(None).cast("double").alias("bound")
    blocks = place(rows).select("dim", "part", F.lit(False).alias("asks"), "id", "vector", none)
    probes = materialize(place(asked), "queries")

    def search(queries: DataFrame) -> DataFrame:
        """Queries with the ``part`` they meet; queries move, and each block moves once."""
        both = blocks.unionByName(queries.select("dim", "part", F.lit(True).alias("asks"), "id", "vector", "bound"))
        dealt = both.repartition("dim", "part").sortWithinPartitions("dim", "part", "asks", "id", "vector")
        return dealt.mapInArrow(lambda it: _search_blocks(it, k, projections), "query_id bigint, vec_id bigint, score double")

    # Every query meets every block of vectors of its length: the stated queries against all rows.
    first = materialize(search(probes.withColumn("bound", none)), "first-block")
    bounds = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))
    others = probes.join(bounds, "id", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part")
    found = first.unionByName(search(others.drop("part").withColumnRenamed("other", "part")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
