"""A knowledge base as Parquet tables in versioned folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Versions of tables below a folder; a small table names the newest, so that readers see all of a version or none.

    One writer at a time. A version is never changed, so an old one is a backup.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        context = spark.sparkContext
        self.path = context._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(context._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that were written to the end, in order."""
        if not self.files.exists(self.path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.folder))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self.files.exists(self.path(f"{self.folder}/{n}/_complete")))

    def write(self, tables: dict[str, DataFrame]) -> int:
        """A new version of all tables."""
        version = max(self.versions(), default=0) + 1
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
        self.files.create(self.path(f"{self.folder}/v{version}/_complete")).close()
        return version

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """Tables of a version, the newest by default."""
        version = version or max(self.versions())
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(f"{self.folder}/v{version}")) if s.isDirectory()]
        return {n: self.spark.read.parquet(f"{self.folder}/v{version}/{n}") for n in names}

    def keep(self, n: int) -> None:
        """Deletes all but the newest versions."""
        for version in self.versions()[:-n]:
            self.files.delete(self.path(f"{self.folder}/v{version}"), True)


class KeyValues:
    """A small table of keys and values."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def get(self, key: str) -> str | None:
        """A key's value."""
        found = self.rows.where(F.col("key") == key).select("value").first()
        return found[0] if found else None

    def set(self, key: str, value: str) -> KeyValues:
        """The table with a key's value set."""
        one = self.rows.sparkSession.createDataFrame([(key, value)], "key string, value string")
        return KeyValues(self.rows.where(F.col("key") != key).unionByName(one))

    def delete(self, key: str) -> KeyValues:
        """The table without a key."""
        return KeyValues(self.rows.where(F.col("key") != key))
