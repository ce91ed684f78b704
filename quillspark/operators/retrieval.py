"""Tenant-scoped exact nearest passages, and the decision to answer or refuse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vector import SIMILARITY_FLOOR, l2_distance, similarity_from_distance

FETCHED, PASSAGES = 10, 5
#: Queries that meet a block in one matrix product.
ASKED = 128


def require_tenant(workspace: object) -> object:
    """A tenant predicate without a tenant is an error, never everything."""
    if workspace is None or workspace == "":
        raise ValueError("a workspace is required")
    return workspace


def knn(vectors: DataFrame, workspace: object, query: list[float], k: int = 8) -> DataFrame:
    """The ``k`` nearest chunks (8 if ``k`` is not positive) of one tenant: ``chunk_id, distance``.

    The tenant filter reaches the scan, and sorting with the limit is one top-k.
    """
    k = k if k > 0 else 8
    own = vectors.where(F.col("workspace_id") == F.lit(require_tenant(workspace)))
    sized = F.when(F.size("embedding") != len(query), F.raise_error(F.lit("embedding width differs from the query's"))).otherwise(F.col("embedding"))
    near = own.select("chunk_id", l2_distance(sized, F.array(*(F.lit(float(x)) for x in query))).alias("distance"))
    return near.orderBy("distance", "chunk_id").limit(k)


def _closest(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and distances of the ``k`` nearest rows of every query; ties go to the smaller id.

    One matrix product tells which rows can be among them, within its rounding; their
    distances are computed anew, exactly.
    """
    sizes, own = (data**2).sum(axis=1), (queries**2).sum(axis=1)
    rough = np.maximum(sizes + own[:, None] - 2 * (queries @ data.T), 0)
    slack = 1e-9 * (own + sizes.max(initial=0.0)) + 1e-300
    found = []
    for query, near, more in zip(queries, rough, slack, strict=True):
        some = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1] + more) if len(near) > k else np.arange(len(near))
        distance = np.sqrt(((data[some] - query) ** 2).sum(axis=1))
        best = np.lexsort((ids[some], distance))[:k]
        found.append((some[best], distance[best]))
    return found


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of block after block, its vectors before its queries: hold the vectors, and answer queries as they come, ``ASKED`` at once."""
    now, held, data, ids, order = None, [], None, None, None
    for batch in batches:
        keys = [*zip(batch.column("workspace_id").to_pylist(), batch.column("part").to_pylist(), batch.column("asks").to_pylist(), strict=True)]
        ends = [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for start, end in zip([0, *ends], ends, strict=False):
            (workspace, part, asks), rows = keys[start], batch.slice(start, end - start)
            if now != (workspace, part):
                now, held, data = (workspace, part), [], None
            if not asks:
                held.append(rows)
                continue
            if not held:
                continue  # no vector fell into this block
            if data is None:
                ids = pa.concat_arrays([r.column("chunk_id") for r in held])
                order = pc.rank(ids, tiebreaker="dense").to_numpy()
                data = _rows([r.column("vector") for r in held])
            for few in (rows.slice(i, ASKED) for i in range(0, len(rows), ASKED)):
                queries = _rows([few.column("vector")])
                if queries.shape[1] != data.shape[1]:
                    raise ValueError("embedding width differs from the query's")
                found = _closest(data, order, queries, k)
                at = pa.array(np.repeat(np.arange(len(found)), [len(n) for n, _ in found]))
                chunks = ids.take(pa.array(np.concatenate([n for n, _ in found])))
                columns = [few.column("workspace_id").take(at), few.column("query_id").take(at), chunks, pa.array(np.concatenate([d for _, d in found]))]
                yield pa.RecordBatch.from_arrays(columns, ["workspace_id", "query_id", "chunk_id", "distance"])


def _rows(vectors: list[pa.Array]) -> np.ndarray:
    if len({len(v) for part in vectors for v in part}) > 1:
        raise ValueError("embedding width differs from the query's")
    return np.concatenate([part.flatten().to_numpy() for part in vectors]).astype(np.float64).reshape(sum(map(len, vectors)), -1)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = FETCHED, block_rows: int = 4096) -> DataFrame:
    """Nearest chunks of every ``(workspace_id, query_id, query)`` within its tenant: ``rank`` from 1.

    Vectors of a tenant are dealt into blocks of about ``block_rows``, so a large
    tenant is spread over many tasks.  A block moves once and is held by one task;
    the tenant's queries stream past it and leave their ``k`` best.
    """
    types = {"workspace_id": vectors, "query_id": queries, "chunk_id": vectors}
    kinds = {c: df.schema[c].dataType for c, df in types.items()}
    wide = {vectors.schema["embedding"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()}
    vector = lambda c: F.col(c) if len(wide) == 1 else F.col(c).cast("array<double>")
    counts = vectors.groupBy("workspace_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("chunk_id", "embedding"), F.col("parts")).cast("int")
    blocks = vectors.join(counts, "workspace_id").select("workspace_id", part.alias("part"), F.lit(False).alias("asks"), "chunk_id", F.lit(None).cast(kinds["query_id"]).alias("query_id"), vector("embedding").alias("vector"))
    met = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asked = queries.join(counts, "workspace_id").select("workspace_id", met, F.lit(True).alias("asks"), F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"), "query_id", vector("query").alias("vector"))
    work = blocks.unionByName(asked).repartition("workspace_id", "part").sortWithinPartitions("workspace_id", "part", "asks")
    kind = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())
    pairs = work.mapInArrow(lambda it: _nearest(it, k), f"{kind}, distance double")
    best = Window.partitionBy("workspace_id", "query_id").orderBy("distance", "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def decide(hits: DataFrame, floor: float = SIMILARITY_FLOOR, keys: tuple[str, ...] = ("workspace_id", "query_id")) -> DataFrame:
    """Per question: outcome, top similarity of all hits (0 if none), and the passages kept, nearest first."""
    scored = hits.withColumn("similarity", similarity_from_distance(F.col("distance")))
    kept = F.when(F.col("similarity") >= floor, F.struct("rank", "chunk_id"))
    found = scored.groupBy(*keys).agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("top_similarity"), F.slice(F.sort_array(F.collect_list(kept)), 1, PASSAGES).alias("kept"))
    outcome = F.when(F.size("kept") > 0, "answered").otherwise("refused")
    return found.select(*keys, outcome.alias("outcome"), "top_similarity", F.transform("kept", lambda x: x["chunk_id"]).alias("passages"))


def cite(hits: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Text and source of hits; hits without a chunk go (after top-k), missing sources are empty strings."""
    texts = hits.join(chunks, "chunk_id").join(sources, "source_id", "left")
    return texts.withColumns({"title": F.coalesce("title", F.lit("")), "url": F.coalesce("url", F.lit(""))})


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk is gone."""
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def sweep(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors that still have their chunk."""
    return vectors.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def floor_of(config: Column) -> Column:
    """A workspace's own similarity floor where it is a number in (0, 1], else the default."""
    v = F.get_json_object(config, "$.similarityFloor").try_cast("double")
    return F.when((v > 0) & (v <= 1), v).otherwise(SIMILARITY_FLOOR)
