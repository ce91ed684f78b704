"""Access rules and filters: what values can't do, and rules of one and the same membership."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import access, records


@pytest.fixture(scope="module")
def team(spark):
    memberships = spark.createDataFrame([("w1", "ann", "owner"), ("w1", "bob", "agent"), ("w2", "bob", "admin"), ("w3", "eve", "owner")], "workspace string, user string, role string")
    workspaces = spark.createDataFrame([("w1", "a1"), ("w2", "a2"), ("w3", "a3")], "workspace string, account string")
    return memberships, workspaces


def names(rows, column):
    return sorted(r[column] for r in rows.collect())


def test_manager_rule_is_of_one_membership(spark, team):
    """An agent isn't let through because somebody else owns the workspace."""
    sources = spark.createDataFrame([("s1", "w1"), ("s2", "w2"), ("s3", "w3")], "source string, workspace string")
    assert names(access.permitted(sources, "sources", "delete", "bob", *team), "source") == ["s2"]
    assert names(access.permitted(sources, "sources", "list", "bob", *team), "source") == ["s1", "s2"]
    assert names(access.permitted(sources, "sources", "delete", "ann", *team), "source") == ["s1"]


@pytest.mark.parametrize("user", ["", None, "nobody", "x' OR '1'='1", "ann' --", ":user", "$who", "{memberships}"])
def test_strangers_and_injected_values_get_nothing(spark, team, user):
    sources = spark.createDataFrame([("s1", "w1")], "source string, workspace string")
    assert access.permitted(sources, "sources", "list", user, *team).count() == 0


def test_backend_only(spark, team):
    rows = spark.createDataFrame([("w1", "a1")], "workspace string, account string")
    for collection, action in [("chunks", "delete"), ("messages", "update"), ("workspaces", "delete"), ("accounts", "update"), ("usage", "update"), ("billing_events", "list"), ("leads", "update"), ("memberships", "create")]:
        assert access.permitted(rows, collection, action, "ann", *team).count() == 0, (collection, action)
    with pytest.raises(ValueError):
        access.rule("sources", "drop")


def test_accounts_over_two_hops(spark, team):
    accounts = spark.createDataFrame([("a1",), ("a2",), ("a3",)], "account string")
    assert names(access.permitted(accounts, "accounts", "list", "bob", *team), "account") == ["a1", "a2"]


def test_requests(spark, team):
    rows = [(1, "ann", "w1", {"name": "x"}), (2, "ann", "w1", {"account": "a9"}), (3, "bob", "w1", {"name": "x"}), (4, "ann", "w2", {"name": "x"}), (5, "bob", "w2", {"name": "x", "widget_key": "k"}), (6, "ann", "w1", None), (7, None, "w1", {})]
    requests = spark.createDataFrame(rows, "id int, user string, workspace string, body map<string,string>")
    got = {r["id"]: r["allowed"] for r in access.judged(requests, "workspaces", "update", *team).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: False}
    said = spark.createDataFrame([(1, "bob", "w1", {"role": "human"}), (2, "bob", "w1", {"role": "assistant"}), (3, "bob", "w3", {"role": "human"}), (4, "bob", "w1", {}), (5, "bob", "w1", None)], requests.schema)
    assert {r["id"]: r["allowed"] for r in access.judged(said, "messages", "create", *team).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r["allowed"] for r in access.judged(said, "messages", "delete", *team).collect()} == {False}


def test_filters_bind_values(spark):
    rows = spark.createDataFrame([(1, "it's", 5), (2, "x", 6), (3, None, 7)], "id int, name string, n int")
    assert names(records.matching(rows, "r.name = :name", {"name": "it's"}), "id") == [1]
    assert names(records.matching(rows, "r.name = :name", {"name": "x' OR true OR 'a'='"}), "id") == []
    assert names(records.matching(rows, "array_contains(:ids, r.id) AND r.n > :n", {"ids": [1, 3], "n": 5}), "id") == [3]
    assert names(records.matching(rows, F.col("n") > 5), "id") == [2, 3]
    assert names(records.matching(rows, ""), "id") == [1, 2, 3]
    assert [r["id"] for r in records.find(rows, "r.n > 0", sort="-n,id", limit=2).collect()] == [3, 2]
    assert records.first(rows, "r.n > :n", params={"n": 5}, sort="n").first()["id"] == 2
    with pytest.raises(ValueError):
        records.find(rows, "true", sort="n; drop table x")


def test_rules_are_semi_joins(spark, team):
    sources = spark.createDataFrame([("s1", "w1")], "source string, workspace string")
    plan = access.permitted(sources, "sources", "list", "ann", *team)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Cross" not in plan
