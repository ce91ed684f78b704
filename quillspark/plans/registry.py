"""Queries of the knowledge-base operators, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import access, knowledge, relational, streams, support, texts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return relational.QUERIES | texts.QUERIES | streams.QUERIES | support.QUERIES | access.QUERIES | knowledge.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.ORACLES | texts.ORACLES | streams.ORACLES | support.ORACLES | access.ORACLES | knowledge.ORACLES
