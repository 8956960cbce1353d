"""From raw documents to token files: quality, near duplicates, benchmark items, mixture, tokens.

Each stage reads what its predecessor wrote and hands all it keeps to the next, with the columns of ``documents``. The
mixing stage keeps every document; its decision is the order of the rows in its files, and the last stage writes the
tokens in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fleetlens.llm.common import prepare, scratch_path, table
from fleetlens.llm.contamination import clean_documents
from fleetlens.llm.dart_minhash import one_per_class
from fleetlens.llm.mixing import in_mixing_order
from fleetlens.llm.quality import good_documents
from fleetlens.llm.token_files import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return good_documents(docs, table(prepare(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    prepare(spark)
    return one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, table(prepare(spark), sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files ordered by the schedule of their source blocks."""
    prepare(spark)
    return in_mixing_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the rows in the files of ``docs``, read back. Without files (in tests): by id."""
    prepare(spark)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
        docs = docs.select("doc_id", "text", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
        order = ["_part", "_row"]
        docs.schema  # noqa: B018  (raises if the rows do not come from files)
    except AnalysisException:
        order = ["doc_id"]
    return read_token_files(write_token_files(docs, order))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokenize", tokenize)]

#: A trained classifier and sampled signatures have no statement in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
