"""Catalog tables as Parquet snapshots: written to new folders, then made current by one small numbered file.

A commit names the folders of all tables in the next pointer file, which exists whole or not at all, and never replaces
one. Readers take the pointer with the highest number, so they see the snapshot before or after a commit, and a commit
that breaks off leaves the one before. Commits of different tables at one time both stand; of two that change one table
the later is refused, since it was made of rows that are no longer current."""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Readers skip names that begin with an underscore or a dot, so this one has neither.
POINTER = re.compile(r"CURRENT-(\d{12})\.json")


class ConcurrentCommit(RuntimeError):
    """A table was changed by another commit since this one began."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _latest(self) -> tuple[int, dict[str, str]]:
        """The highest pointer's number, 0 if there is none, and the folder that it gives each table."""
        fs, root = self._fs(), self._path("")
        if not fs.exists(root):
            return 0, {}
        found = [m for f in fs.listStatus(root) if (m := POINTER.fullmatch(f.getPath().getName()))]
        if not found:
            return 0, {}
        last = max(found, key=lambda m: int(m[1]))
        return int(last[1]), json.loads(self.spark.read.text(f"{self.root}/{last[0]}", wholetext=True).first()[0])

    def versions(self) -> dict[str, str]:
        """The current folder of each table."""
        return self._latest()[1]

    def _publish(self, number: int, folders: dict[str, str]) -> bool:
        """Makes the pointer of that number, unless there is one: written elsewhere first, so that it is never seen half."""
        fs, fresh, final = self._fs(), self._path(f"new-{uuid.uuid4().hex}"), self._path(f"CURRENT-{number:012d}.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() != "file":  # a rename onto a file that exists fails
                return not fs.exists(final) and fs.rename(fresh, final)
            os.link(fresh.toUri().getPath(), final.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(fresh, False)

    def read(self, table: str, schema: StructType | None = None) -> DataFrame:
        """A table's current rows; with a schema a table that was never written is empty."""
        folder = self.versions().get(table)
        if folder is None:
            if schema is None:
                raise LookupError(table)
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{folder}")

    def commit(self, tables: dict[str, DataFrame], sort_by: dict[str, list[str]] | None = None) -> None:
        """Writes all tables, then points to them. Sorting within files keeps their statistics narrow for later filters."""
        before, fresh = self.versions(), {}
        for name, df in tables.items():
            fresh[name] = f"{name}-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
            keys = (sort_by or {}).get(name)
            (df.sortWithinPartitions(*keys) if keys else df).write.option("compression", "zstd").parquet(f"{self.root}/{fresh[name]}")
        while True:
            number, now = self._latest()
            if changed := [name for name in fresh if now.get(name) != before.get(name)]:
                raise ConcurrentCommit(", ".join(changed))
            if self._publish(number + 1, now | fresh):
                return


def read_table(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """A catalog table from Parquet, or over JDBC (a driver must be on the class path) with keyed, parallel reads."""
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=source, **options).load()
    return spark.read.parquet(source)
