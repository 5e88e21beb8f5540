"""Named tables in a folder, replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The version of the tables' layout; older tables get the columns that were added since.
VERSION = 2
ADDED = {2: {"graph_nodes": [("branch", T.StringType()), ("commit_sha", T.StringType())]}}


class Store:
    """Each table is a folder of versions with numbered pointers to them, of which the greatest counts, so that readers never see half a table and a crash at any point leaves a readable one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[str]:
        """Names of the pointers (number, version), oldest first."""
        root = self._path(f"{self.path}/{name}")
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(root)) if n.startswith("at-")) if self.fs.exists(root) else []

    def _current(self, name: str) -> str | None:
        at = self._pointers(name)
        return at[-1].rsplit("-", 1)[1] if at else None

    def save(self, name: str, df: DataFrame) -> None:
        """Write a new version, then its pointer (an empty file, whose name says all); only then are older pointers and versions deleted."""
        old, new = self._pointers(name), uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}/{new}")
        number = int(old[-1].split("-")[1]) + 1 if old else 1
        self.fs.create(self._path(f"{self.path}/{name}/at-{number:012}-{new}"), False).close()
        for pointer in old:
            self.fs.delete(self._path(f"{self.path}/{name}/{pointer}"), False)
            self.fs.delete(self._path(f"{self.path}/{name}/{pointer.rsplit('-', 1)[1]}"), True)

    def load(self, name: str, version: int = VERSION) -> DataFrame:
        """The current table, brought to the present layout."""
        at = self._current(name)
        if at is None:
            raise KeyError(name)
        df = self.spark.read.parquet(f"{self.path}/{name}/{at}")
        for v in sorted(ADDED):
            if v <= version:
                for column, kind in ADDED[v].get(name, []):
                    if column not in df.columns:
                        df = df.withColumn(column, F.lit(None).cast(kind))
        return df

    def tables(self) -> list[str]:
        root = self._path(self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(root)) if self.fs.exists(root) else []

    def info(self) -> dict:
        return {"version": VERSION, "tables": self.tables()}

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)

    def compact(self, name: str, files: int = 1) -> None:
        self.save(name, self.load(name).repartition(files))
