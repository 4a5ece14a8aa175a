"""Small keyed tables that micro-batches advance: what a decision needs of the past, without the past."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class KeyedState:
    """A table in versions, one folder per micro-batch.

    A batch reads the newest version before its own and writes its own, so a batch that is
    repeated reads and writes the same. Older versions are deleted; the table is as large as its
    keys, whatever the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str) -> None:
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], schema).schema
        self._folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self._files.exists(self._folder):
            return []
        names = (f.getPath().getName() for f in self._files.listStatus(self._folder))
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def before(self, batch_id: int) -> DataFrame:
        """The version that batch ``batch_id`` starts from; empty for the first."""
        earlier = [v for v in self._versions() if v < batch_id]
        if not earlier:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._at(earlier[-1]))

    def latest(self) -> DataFrame:
        return self.before(1 << 62)

    def store(self, rows: DataFrame, batch_id: int) -> None:
        """Writes the version of ``batch_id`` and deletes those that no repeat can ask for."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._at(batch_id))
        for version in [v for v in self._versions() if v < batch_id][:-1]:
            self._files.delete(self._path(version), True)

    def _path(self, version: int):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(version))
