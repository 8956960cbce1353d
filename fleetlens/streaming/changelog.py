"""What the micro-batches of a stream wrote, read as one table and compacted.

``batches/batch=i`` holds the rows of micro-batch i; a retried batch overwrites its own folder. Every row has a key, and of
the rows of one key the one of the greatest order counts. A compaction writes the table so far as ``base/upto=i`` and then
a mark; readers take the newest marked base and the batches behind it, so a compaction that dies leaves the older base in
use, and reading costs one table plus what came since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException


class Changelog:
    def __init__(self, spark: SparkSession, location: str, schema: StructType, key: list[str], order: list[str]):
        """``order`` may name ``batch``, the number of the micro-batch."""
        self.spark, self.location, self.schema, self.key, self.order = spark, location, schema, key, order

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        batch.write.mode("overwrite").parquet(f"{self.location}/batches/batch={batch_id}")

    def _marked(self) -> int:
        """The newest complete base, or -1."""
        try:
            return self.spark.read.schema("upto bigint").json(f"{self.location}/marks").agg(F.max("upto")).first()[0]
        except AnalysisException:  # no mark yet
            return -1

    def _log(self, upto: int) -> DataFrame:
        full = StructType([*self.schema.fields, StructField("batch", LongType())])
        log = self.spark.read.schema(full).option("basePath", f"{self.location}/batches").parquet(f"{self.location}/batches").filter(F.col("batch") > upto)
        if upto < 0:
            return log
        return self.spark.read.schema(full).parquet(f"{self.location}/base/upto={upto}").unionByName(log)

    def _folded(self, upto: int) -> DataFrame:
        rest = [c for c in [*self.schema.names, "batch"] if c not in self.key]
        newest = F.max_by(F.struct(*rest), F.struct(*self.order))
        return self._log(upto).groupBy(*self.key).agg(newest.alias("r")).select(*self.key, "r.*")

    def read(self) -> DataFrame:
        """The row that counts of every key."""
        return self._folded(self._marked()).drop("batch")

    def compact(self) -> int:
        """Write a new base; returns the last batch it holds. The files behind it are no longer read."""
        marked = self._marked()
        last = self._log(marked).agg(F.max("batch")).first()[0]
        if last is not None and last > marked:
            self._folded(marked).write.mode("overwrite").parquet(f"{self.location}/base/upto={last}")
            self.spark.range(1).select(F.lit(last).cast("bigint").alias("upto")).write.mode("append").json(f"{self.location}/marks")
        return marked if last is None else last
