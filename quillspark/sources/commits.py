"""Several tables that change together, in a shared folder.

Rows of a commit are staged as Parquet under a name of their own, one folder a table;
a small numbered file then publishes all of them at once.  Until it is whole nobody
reads them, so a job that dies between two tables, or between staging and publishing,
leaves every reader at the version before.  Deletions are keys that hold for the rows
of earlier commits; replacing is deleting and adding in one commit.  ``compact`` writes
a table anew, after which earlier folders aren't read any more.

Readers see the version there is when they start.  A writer that depends on what it
read passes ``expect``; it fails where somebody else has published since.  A commit with
a ``tag`` that was published before does nothing, which makes repeated micro-batches
harmless.  The driver lists commits since the last compaction, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another commit was published after the version that this one was made from."""


class Store:
    """Tables by name with their columns (DDL), the columns that their folders are cut by, and a check of rows before they are written."""

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, str], partitions: dict[str, list[str]] | None = None, check: Callable[[DataFrame, str], DataFrame] | None = None):
        self.spark, self.base, self.tables, self.partitions, self.check = spark, base.rstrip("/"), tables, partitions or {}, check

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def log(self, version: int | None = None) -> list[tuple[int, dict]]:
        """Published commits in order, up to ``version``."""
        fs, folder = self._path("_commits")
        found = []
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            if name.isdigit() and (version is None or int(name) <= version):
                stream = fs.open(status.getPath())
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                if text.endswith("\n"):  # written whole
                    found.append((int(name), json.loads(text)))
        return sorted(found, key=lambda entry: entry[0])

    def version(self) -> int:
        """Number of the last commit, 0 before the first."""
        return max((n for n, _ in self.log()), default=0)

    def _publish(self, entry: dict, expect: int | None) -> int:
        """Take the next free number; a number taken by a writer that died in between stays void."""
        number = (self.version() if expect is None else expect) + 1
        while True:
            fs, path = self._path(f"_commits/{number:012d}")
            try:
                out = fs.create(path, False)
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                    raise
                if expect is not None and self.version() > expect:
                    raise Conflict(f"version {expect} is not the last any more") from None
                number += 1
                continue
            out.write(bytearray((json.dumps(entry) + "\n").encode()))
            out.close()
            return number

    def commit(self, rows: dict[str, DataFrame] | None = None, gone: dict[str, list[DataFrame]] | None = None, expect: int | None = None, tag: str | None = None) -> int:
        """Publish ``rows`` to add and ``gone``, keys whose earlier rows go; returns the version."""
        log = self.log()
        if tag is not None and any(entry["tag"] == tag for _, entry in log):
            return max(n for n, _ in log)
        if expect is not None and max((n for n, _ in log), default=0) != expect:
            raise Conflict(f"version {expect} is not the last any more")
        return self._publish({"tag": tag, "tables": self._stage(rows or {}, gone or {})}, expect)

    def _stage(self, rows: dict[str, DataFrame], gone: dict[str, list[DataFrame]]) -> dict[str, dict]:
        tables: dict[str, dict] = {}
        for name, added in rows.items():
            tables.setdefault(name, {"gone": []})["rows"] = mark = uuid.uuid4().hex
            exact = added.to(self._schema(name))
            writer = (self.check(exact, name) if self.check else exact).write
            writer.partitionBy(*self.partitions.get(name, [])).parquet(f"{self.base}/{name}/commit={mark}")
        for name, all_keys in gone.items():
            for keys in all_keys:
                mark = uuid.uuid4().hex
                keys.distinct().write.parquet(f"{self.base}/{name}-gone/{mark}")
                tables.setdefault(name, {"gone": []})["gone"].append([mark, keys.columns])
        return tables

    def _schema(self, name: str):
        return self.spark.createDataFrame([], self.tables[name]).schema

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table at a version (the last, if not given)."""
        log = [(n, entry["tables"][name]) for n, entry in self.log(version) if name in entry["tables"]]
        start = max((i for i, (_, part) in enumerate(log) if part.get("compacted")), default=0)
        added = {part["rows"]: n for n, part in log[start:] if "rows" in part}
        if not added:
            return self.spark.createDataFrame([], self.tables[name])
        reader = self.spark.read.schema(f"{self.tables[name]}, commit string").option("basePath", f"{self.base}/{name}")
        rows = reader.parquet(*(f"{self.base}/{name}/commit={mark}" for mark in added))
        keyed: dict[tuple, list[DataFrame]] = {}
        for n, part in log[start:]:
            for mark, columns in part["gone"]:
                if n > min(added.values()):
                    keys = self.spark.read.parquet(f"{self.base}/{name}-gone/{mark}")
                    keyed.setdefault(tuple(columns), []).append(keys.withColumn("until", F.lit(n)))
        if keyed:
            number = F.create_map(*(F.lit(x) for pair in added.items() for x in pair))
            rows = rows.withColumn("commit", number[F.col("commit")])
        for columns, parts in keyed.items():
            ends = reduce(DataFrame.unionByName, parts).groupBy(*columns).agg(F.max("until").alias("until"))
            ends = ends.withColumnsRenamed({c: f"gone_{c}" for c in columns})
            same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in columns))
            rows = rows.join(ends, same & (F.col("commit") < F.col("until")), "left_anti")
        return rows.select(*self._schema(name).names)

    def replace(self, name: str, keys: list[str], rows: DataFrame) -> tuple[dict[str, DataFrame], dict[str, list[DataFrame]]]:
        """What a commit takes to put ``rows`` in place of those with the same keys."""
        return {name: rows}, {name: [rows.select(*keys)]}

    def compact(self, name: str) -> int:
        """Write a table anew as it is now; fails with ``Conflict`` where somebody publishes meanwhile."""
        now = self.version()
        tables = self._stage({name: self.read(name, now)}, {})
        tables[name]["compacted"] = True
        return self._publish({"tag": None, "tables": tables}, now)
