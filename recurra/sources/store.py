"""Stored tables as numbered snapshots: a write makes a new one, and readers take the last that is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES


class Store:
    """A folder that all executors reach. Snapshots replace in-place writes, so a lost executor or a failed
    job leaves the last complete table. Two are kept, as running plans may still read the one before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        versions = self._versions(table)
        if not versions:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}/v{versions[-1]}")

    def write(self, table: str, df: DataFrame) -> None:
        versions = self._versions(table)
        schema = TABLES[table]
        cols = [df[f.name].cast(f.dataType).alias(f.name) for f in schema]
        df.select(*cols).write.mode("overwrite").parquet(f"{self.root}/{table}/v{(versions[-1] if versions else 0) + 1}")
        for old in versions[:-1]:
            self._fs.delete(self._path(f"{self.root}/{table}/v{old}"), True)
