"""Batch search against brute force, over several blocks, ties, widths and types."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval


def brute(vectors, queries, k):
    found = set()
    for w, q, x in queries:
        near = sorted((float(np.sqrt(((np.array(v, dtype=np.float64) - np.array(x, dtype=np.float64)) ** 2).sum())), c) for own, c, v in vectors if own == w)
        found |= {(w, q, c, i + 1) for i, (_, c) in enumerate(near[:k])}
    return found


@pytest.mark.parametrize("block_rows", [7, 40, 4096])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_of_every_query(spark, block_rows, kind):
    rng = np.random.default_rng(3)
    vectors = [(f"w{i % 3 if i % 5 else 0}", i, [float(np.float32(x)) for x in rng.integers(-2, 3, 6)]) for i in range(150)] + [("lone", 900, [1.0] * 6)]
    queries = [(w, i, v) for w, i, v in vectors[::4]] + [("lone", 901, [0.5] * 6), ("nobody", 902, [0.0] * 6), ("w1", 903, [1e-3] * 6)]
    df = spark.createDataFrame(vectors, "workspace_id string, chunk_id int, embedding array<float>").repartition(4)
    asked = spark.createDataFrame(queries, f"workspace_id string, query_id int, query array<{kind}>")
    got = {(r["workspace_id"], r["query_id"], r["chunk_id"], r["rank"]) for r in retrieval.knn_batch(df, asked, 5, block_rows).collect()}
    exact = [(w, q, [float(np.float32(x)) if kind == "float" else x for x in v]) for w, q, v in queries]
    assert got == brute(vectors, exact, 5)


def test_widths_must_agree(spark):
    df = spark.createDataFrame([("w", 1, [1.0, 2.0])], "workspace_id string, chunk_id int, embedding array<float>")
    with pytest.raises(Exception, match="width"):
        retrieval.knn_batch(df, df.select("workspace_id", F.lit(1).alias("query_id"), F.array(F.lit(1.0)).alias("query"))).collect()
    assert retrieval.knn_batch(df.limit(0), df.select("workspace_id", F.lit(1).alias("query_id"), F.col("embedding").alias("query"))).count() == 0


def test_memory_does_not_follow_the_queries_of_a_batch():
    rng = np.random.default_rng(5)

    def rows(n, asks):
        ids = pa.array(range(n), pa.int64())
        vectors = pa.ListArray.from_arrays(np.arange(0, 8 * n + 1, 8, dtype=np.int32), pa.array(rng.random(8 * n)))
        none = pa.nulls(n, pa.int64())
        columns = {"workspace_id": pa.array([1] * n), "part": pa.array([0] * n), "asks": pa.array([asks] * n), "chunk_id": none if asks else ids, "query_id": ids if asks else none, "vector": vectors}
        return pa.RecordBatch.from_pydict(columns)

    work = [rows(2048, False), rows(3000, True)]
    tracemalloc.start()
    found = sum(len(b) for b in retrieval._nearest(iter(work), 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 9000
    assert peak < 24 << 20
