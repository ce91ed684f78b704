"""Lookups of single records and pages of records.

A filter is a Column or a Spark SQL condition over the record ``r`` with named
parameters (``r.status <> :status``).  Parameters are bound, never written into the
text, so a value can't change what a filter asks.  Relations, passed by name, are
reached as in SQL: ``EXISTS (SELECT 1 FROM {memberships} m WHERE …)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(rows: DataFrame, id_col: str, value: object) -> DataFrame:
    """The record with an id: one row or none; the filter reaches the scan."""
    return rows.where(F.col(id_col) == F.lit(value)).limit(1)


def matching(rows: DataFrame, condition: Column | str, params: dict[str, object] | None = None, **relations: DataFrame) -> DataFrame:
    """Records that meet a condition; a list is bound as an array, for ``array_contains(:ids, r.id)``."""
    if isinstance(condition, Column):
        return rows.where(condition)
    args = {name: F.array(*map(F.lit, value)) if isinstance(value, list | tuple) else value for name, value in (params or {}).items()}
    return rows.sparkSession.sql(f"SELECT r.* FROM {{rows}} r WHERE {condition or 'true'}", args=args, rows=rows, **relations)


def order_of(rows: DataFrame, sort: str) -> list[Column]:
    """Columns of a sort string such as ``-created,name``: a minus for descending; unknown columns are an error."""
    found = []
    for part in filter(None, map(str.strip, sort.split(","))):
        descending, name = re.fullmatch(r"([-+]?)(\w+)", part).groups() if re.fullmatch(r"[-+]?\w+", part) else ("", part)
        if name not in rows.columns:
            raise ValueError(f"no column to sort by: {name}")
        found.append(F.desc(name) if descending == "-" else F.asc(name))
    return found


def find(rows: DataFrame, condition: Column | str, *order: Column | str, limit: int = 0, offset: int = 0, params: dict[str, object] | None = None, sort: str = "", **relations: DataFrame) -> DataFrame:
    """Records that meet a condition, in order; a limit of zero is none."""
    found = matching(rows, condition, params, **relations)
    order = (*order, *order_of(rows, sort))
    found = found.orderBy(*order) if order else found
    found = found.offset(offset) if offset else found
    return found.limit(limit) if limit else found


def first(rows: DataFrame, condition: Column | str, *order: Column | str, params: dict[str, object] | None = None, sort: str = "", **relations: DataFrame) -> DataFrame:
    """The first record that meets a condition: one row or none."""
    return find(rows, condition, *order, limit=1, params=params, sort=sort, **relations)
