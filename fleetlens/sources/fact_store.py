"""A store of facts that is laid out for its joins: bucketed by repository, in a base and deltas.

An upsert writes one delta of the new rows and then a mark that lists the base and the deltas in force; nothing stored is
read or written again. A reader takes the newest mark, so a writer that dies before its mark leaves the version before. Base and deltas are partitions of one table
with the same buckets, so finding the newest facts, and joins and aggregations by repository, do not shuffle what is
stored. (Not a union of several tables: Spark 4.1 takes the union of bucketed scans for bucketed and mixes buckets up.) A
compaction folds deltas into a new base.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEY = ["repo", "type", "name"]
ORDER = ["ts", "push_id"]


class FactStore:
    """Facts with (repo, type, name, push_id, ts, sha) and any other columns. One writer at a time.

    ``buckets`` is fixed when the store is made; choose it for the number of cores that read it and for files of some
    hundred MB.
    """

    def __init__(self, spark: SparkSession, location: str, schema: str, buckets: int = 64):
        self.spark, self.location, self.buckets = spark, location.rstrip("/"), buckets
        self.schema = f"{schema}, removed boolean"

    def parts(self) -> list[str]:
        """Partitions of the version in force: the base, then its deltas."""
        try:
            newest = self.spark.read.schema("version bigint, parts string").json(f"{self.location}/marks").orderBy(F.desc("version")).first()
        except AnalysisException:  # nothing was written yet
            newest = None
        return json.loads(newest["parts"]) if newest else []

    def _mark(self, parts: list[str]) -> None:
        try:
            last = self.spark.read.schema("version bigint").json(f"{self.location}/marks").agg(F.max("version")).first()[0]
        except AnalysisException:
            last = 0
        row = self.spark.range(1).select(F.lit(last + 1).cast("bigint").alias("version"), F.lit(json.dumps(parts)).alias("parts"))
        row.write.mode("append").json(f"{self.location}/marks")

    def _table(self) -> str:
        """The name under which this session knows the files."""
        name = f"facts_{hashlib.md5(self.location.encode()).hexdigest()}"
        layout = f"PARTITIONED BY (part) CLUSTERED BY (repo) SORTED BY (repo, type, name) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}, part STRING) USING parquet {layout} LOCATION '{self.location}/parts'")
        return name

    def _write(self, rows: DataFrame) -> str:
        part = f"p{uuid.uuid4().hex}"
        dealt = rows.withColumn("part", F.lit(part)).repartition(self.buckets, "repo")
        writer = dealt.write.mode("append").format("parquet").partitionBy("part").bucketBy(self.buckets, "repo").sortBy(*KEY)
        writer.saveAsTable(self._table())
        return part

    def _rows(self) -> DataFrame:
        name = self._table()
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).filter(F.col("part").isin(self.parts())).drop("part")

    def _newest(self) -> DataFrame:
        age = Window.partitionBy(*KEY).orderBy(*[F.col(c).desc() for c in ORDER])
        return self._rows().withColumn("_rank", F.rank().over(age)).filter("_rank = 1").drop("_rank").dropDuplicates([*KEY, "sha", "removed"])

    def read(self) -> DataFrame:
        """The facts of the newest push of every (repo, type, name); several of one push stay, removed ones do not."""
        gone = F.max("removed").over(Window.partitionBy(*KEY))
        return self._newest().withColumn("_gone", gone).filter(~F.col("_gone")).drop("_gone", "removed")

    def upsert(self, facts: DataFrame) -> None:
        """Add facts; late ones (of an older push than is stored) change nothing that is read."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        parts = self.parts()
        self._mark([*parts, self._write(facts.withColumn("removed", F.lit(False)).select(*names))])

    def remove(self, keys: DataFrame) -> None:
        """Facts that a push no longer has: ``keys`` is (repo, type, name, push_id, ts)."""
        columns = [c.split() for c in self.schema.split(", ")]
        rows = keys.select(*[F.col(c) if c in [*KEY, *ORDER] else (F.lit(True) if c == "removed" else F.lit(None)).cast(t).alias(c) for c, t in columns])
        parts = self.parts()
        self._mark([*parts, self._write(rows)])

    def compact(self) -> None:
        """Fold base and deltas into a new base; removals stay, so late facts do not come back."""
        if len(self.parts()) > 1:
            self._mark([self._write(self._newest())])
