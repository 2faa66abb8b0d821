"""A store of named tables in a folder: versions of Parquet with an atomic pointer, upserts by key, lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.window import last_write


class Catalog:
    """Tables ``<root>/<name>/<version>``; ``<root>/<name>/_current`` names the version that counts.

    A commit writes a new version as a whole, then moves the pointer, so a failed job leaves the old table in place. The last
    few versions stay, for readers that began before.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(2, keep)

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, name: str) -> str | None:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return None
        marks = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("_current-"))
        return marks[-1].split("-", 2)[2] if marks else None

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; where there is none yet, an empty one of ``schema``."""
        version = self.version(name)
        if version is None:
            if schema is None:
                raise FileNotFoundError(f"no table {name} in {self.root}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> None:
        """A new version; all but the last ``keep`` are removed."""
        jvm, fs = self._fs()
        old = self.version(name)
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{version}")
        number = 0 if old is None else max(int(s.getPath().getName().split("-")[1]) for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")) if s.getPath().getName().startswith("_current-")) + 1
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_current-{number:012d}-{version}"), False).close()
        for status in sorted(fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")), key=lambda s: s.getPath().getName()):
            mark = status.getPath().getName()
            if mark.startswith("_current-") and int(mark.split("-")[1]) <= number - self.keep:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{mark.split('-', 2)[2]}"), True)
                fs.delete(status.getPath(), False)

    def upsert(self, name: str, new: DataFrame, keys: list[str]) -> None:
        """Rows of ``new`` replace those of equal keys; of several for a key in ``new``, any one that is last by value."""
        self.write(name, self.merged(name, new, keys))

    def merged(self, name: str, new: DataFrame, keys: list[str]) -> DataFrame:
        """What ``upsert`` would write."""
        old = self.read(name, None) if self.version(name) else None
        rows = new.withColumn("__v", F.lit(1)) if old is None else old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
        return last_write(rows, keys, "__v").drop("__v")

    def drop_all(self) -> None:
        """Remove every table."""
        jvm, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self.root), True)

    def truncate(self, name: str) -> None:
        self.write(name, self.read(name).limit(0))

    def new_keys(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key the table doesn't have."""
        return rows if self.version(name) is None else rows.join(self.read(name).select(key), key, "left_anti")


def by_ids(table: DataFrame, ids: DataFrame, key: str, order: str, fields: list[str] | None = None) -> DataFrame:
    """The rows for ``ids(key, order)``, in that order, nulls for missing ones; all fields, or those asked for."""
    wanted = table.select(key, *(fields or [c for c in table.columns if c != key]))
    return ids.join(wanted, key, "left").orderBy(order)
