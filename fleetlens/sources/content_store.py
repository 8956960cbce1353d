"""Facts by content: a file is extracted once, however many pushes and repositories hold it.

What an extractor finds depends on the path and the content of a file only, so a file is addressed by (path, hash of the
content). The store keeps the facts of every address, and the addresses that were read (many give no fact). A run reads
the contents of new addresses only and joins the facts back to all files. Facts are written before their addresses, and
the facts of a run count from the moment its addresses stand: a run that dies is done again and leaves nothing behind
that is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fleetlens.operators.aspects import Aspect, fact_items, with_envelope
from fleetlens.session import cut_lineage

ADDRESS = ["path", "content_sha"]


def addressed(files: DataFrame) -> DataFrame:
    """``files`` with ``content_sha``; a null content has the address of its path alone."""
    return files.withColumn("content_sha", F.coalesce(F.sha2("content", 256), F.lit("")))


class ContentStore:
    """Facts of one list of aspects; another list, or another version of an extractor, takes another location."""

    def __init__(self, spark: SparkSession, location: str, aspects: list[Aspect]):
        self.spark, self.location, self.aspects = spark, location.rstrip("/"), aspects

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.location}/{name}")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def addresses(self) -> DataFrame:
        """(path, content_sha, run) of every content that was read."""
        return self._table("addresses", "path string, content_sha string, run string")

    def facts(self) -> DataFrame:
        """(path, content_sha, type, name, data) of complete runs, an address once."""
        held = self._table("facts", "path string, content_sha string, type string, name string, data string, run string")
        return held.join(self._owners(), [*ADDRESS, "run"], "left_semi").drop("run")

    def _owners(self) -> DataFrame:
        """One run of each address: two runs at the same time may both have read it."""
        return self.addresses().groupBy(*ADDRESS).agg(F.min("run").alias("run"))

    def add(self, files: DataFrame) -> int:
        """Extract the contents of ``files(path, content)`` that the store does not hold; returns how many those are."""
        wanted = files.filter(self._applies())
        known = self.addresses().select(*ADDRESS).distinct()
        fresh = cut_lineage(addressed(wanted).select(*ADDRESS).distinct().join(known, ADDRESS, "left_anti"), "new-contents")
        number = fresh.count()
        if number:
            run = uuid.uuid4().hex
            texts = addressed(wanted).select(*ADDRESS, "content").join(fresh, ADDRESS, "left_semi").dropDuplicates(ADDRESS)
            found = fact_items(texts, self.aspects, ADDRESS).withColumn("run", F.lit(run))
            found.write.mode("append").parquet(f"{self.location}/facts")
            fresh.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.location}/addresses")
        return number

    def _applies(self):
        condition = F.lit(False)
        for aspect in self.aspects:
            condition = condition | aspect.applies(F.col("path"))
        return condition

    def extract(self, files: DataFrame, keep: list[str]) -> DataFrame:
        """Facts of ``files(keep, path, content)`` with their envelope, as ``extract_facts`` gives them."""
        self.add(files)
        rows = addressed(files.filter(self._applies())).select(*keep, *ADDRESS)
        names = {c: f"_fl_{c}" for c in ADDRESS}
        facts = self.facts().withColumnsRenamed(names)
        same = (rows["path"] == facts["_fl_path"]) & (rows["content_sha"] == facts["_fl_content_sha"])
        return with_envelope(rows.join(facts, same).select(*[rows[c] for c in keep], "type", "name", "data"), keep)
