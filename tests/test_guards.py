"""Writes and replies that must fail, and do."""

import pytest

from quillspark.operators import embedding
from quillspark.sources import schemas
from quillspark.sources.shared import scratch_path


def vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "workspace string, chunk string, embedding array<float>")


@pytest.mark.parametrize("row", [("w", "c", [1.0]), ("w", "c", [1.0, 2.0, 3.0]), ("w", "c", None), ("", "c", [1.0, 2.0]), (None, "c", [1.0, 2.0])])
def test_vectors_of_another_width_or_without_a_tenant(spark, row):
    path = scratch_path(spark, "vectors")
    with pytest.raises(Exception, match="lacks its workspace or has another width"):
        schemas.write_vectors(vectors(spark, ("w", "ok", [1.0, 2.0]), row), path, 2)
    schemas.write_vectors(vectors(spark, ("w", "ok", [1.0, 2.0])), path, 2)
    assert [r["chunk"] for r in spark.read.parquet(path).collect()] == ["ok"]


def asked(spark):
    return spark.createDataFrame([("w", 0, i, f"t{i}") for i in range(3)], "workspace string, batch int, index int, text string")


def answered(spark, *rows):
    return spark.createDataFrame([("w", 0, i, v) for i, v in rows], "workspace string, batch int, index int, embedding array<double>")


ONE = [0.0, 1.0]


@pytest.mark.parametrize(
    "rows,message",
    [([(0, ONE), (1, ONE), (2, ONE), (3, ONE)], "index out of range: 3"), ([(0, ONE), (2, ONE)], "no embedding for input 1"), ([(0, ONE), (1, ONE), (1, ONE), (2, ONE)], "duplicate index 1"), ([(0, ONE), (1, [1.0]), (2, ONE)], "dimension mismatch: 1")],
)
def test_replies_of_an_embedding_service(spark, rows, message):
    with pytest.raises(Exception, match=message):
        embedding.embedded(asked(spark), answered(spark, *rows), ["workspace"], 2).collect()


def test_replies_in_any_order(spark):
    got = embedding.embedded(asked(spark), answered(spark, (2, [2.0, 0.0]), (0, [0.0, 0.0]), (1, [1.0, 0.0])), ["workspace"], 2).collect()
    assert {r["text"]: r["embedding"][0] for r in got} == {"t0": 0.0, "t1": 1.0, "t2": 2.0}


def test_vocabularies_hold_for_every_column(spark):
    kind = "message string, role string, outcome string, rating string"
    good = spark.createDataFrame([("m", "user", "", None), ("n", "human", None, "up")], kind)
    assert schemas.checked(good, "messages").count() == 2 and sorted(schemas.checked(good, "messages").collect()) == sorted(good.collect())
    for row, column in [(("m", "robot", "", ""), "role"), (("m", "user", "lost", ""), "outcome"), (("m", "user", "", "meh"), "rating")]:
        bad = schemas.checked(spark.createDataFrame([row], kind), "messages")
        with pytest.raises(Exception, match=f"messages.{column} can't be"):
            bad.select(column).collect()


def test_tables_are_read_with_their_schema(spark):
    path = scratch_path(spark, "leads")
    spark.createDataFrame([("l", "w", None)], "lead string, workspace string, name string").write.parquet(path)
    row = schemas.read_table(spark, path, "leads").first()
    assert (row["lead"], row["name"], row["question"], row["created"]) == ("l", "", "", None)
