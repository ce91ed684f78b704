"""Runs a query and its SQL over the same tables and compares the rows as multisets."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def check(spark, query, sql, sf_dir):
    with duckdb.connect() as db:
        for name in TABLES:
            if Path(f"{sf_dir}/{name}.parquet").exists():
                db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
        found = db.execute(sql)
        want = rows_of([d[0] for d in found.description], found.fetchall())
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    extra, missing = got[1] - want[1], want[1] - got[1]
    assert not extra and not missing, f"{sum(extra.values())} rows too many, as {list(extra)[:2]}; {sum(missing.values())} missing, as {list(missing)[:2]}"
