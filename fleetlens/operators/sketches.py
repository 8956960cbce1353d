"""Mergeable summaries of facts and builds, stored once and merged for any range of months and any owner.

A summary row belongs to one cell (a month and what is reported by); its sketch has a size that does not depend on the rows
it has seen. New rows are summarised and appended, nothing is read again; a report merges the cells it asks for. Variants
are counted by HyperLogLog sketches, durations by KLL quantile sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2^LG_CONFIG registers: a standard error of about 1.04 / sqrt(4096), 1.6 %, in at most 4 KB (few values are exact).
LG_CONFIG = 12
#: Items of a quantile sketch: ranks are off by at most about 1.3 %; up to so many values are exact.
KLL_ITEMS = 200
VARIANT_CELL = ["month", "type", "name", "owner"]
BUILD_CELL = ["month", "repo"]


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def variant_sketches(facts: DataFrame) -> DataFrame:
    """(month, type, name, owner, uses, sketch) of facts (type, name, owner, sha, ts)."""
    cells = facts.withColumn("month", month(F.col("ts"))).groupBy(*VARIANT_CELL)
    return cells.agg(F.count(F.lit(1)).alias("uses"), F.hll_sketch_agg("sha", LG_CONFIG).alias("sketch"))


def build_sketches(builds: DataFrame) -> DataFrame:
    """(month, repo, builds, seconds, longest, sketch) of builds (repo, ts, value); builds without a duration count, and
    nothing else."""
    cells = builds.withColumn("month", month(F.col("ts"))).groupBy(*BUILD_CELL)
    return cells.agg(
        F.count(F.lit(1)).alias("builds"),
        F.count("value").alias("timed"),
        F.sum("value").alias("seconds"),
        F.max("value").alias("longest"),
        F.kll_sketch_agg_double("value", F.lit(KLL_ITEMS)).alias("sketch"),
    )


def append(summaries: DataFrame, location: str) -> None:
    """Add summaries to a stored table by month. Cells may be appended in parts; parts merge when they are read."""
    summaries.write.mode("append").partitionBy("month").parquet(location)


def stored(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.option("basePath", location).option("partitionColumnTypeInference.enabled", "false").parquet(location).withColumn("month", F.col("month").cast("string"))


def between(summaries: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Cells of the months from ``first`` to ``last`` (yyyy-MM, both included)."""
    out = summaries if first is None else summaries.filter(F.col("month") >= first)
    return out if last is None else out.filter(F.col("month") <= last)


def compact(summaries: DataFrame, cell: list[str]) -> DataFrame:
    """One row per cell, of tables whose cells were appended in parts."""
    if cell == VARIANT_CELL:
        return summaries.groupBy(*cell).agg(F.sum("uses").alias("uses"), F.hll_union_agg("sketch").alias("sketch"))
    return summaries.groupBy(*cell).agg(
        *[F.sum(c).alias(c) for c in ("builds", "timed", "seconds")], F.max("longest").alias("longest"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def variants(summaries: DataFrame, by: list[str]) -> DataFrame:
    """(by, uses, variants): estimated different variants of all cells that are alike in ``by``."""
    merged = summaries.groupBy(*by).agg(F.sum("uses").alias("uses"), F.hll_union_agg("sketch").alias("_sketch"))
    return merged.select(*by, "uses", F.hll_sketch_estimate("_sketch").alias("variants"))


def build_quantiles(summaries: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, builds, mean_seconds, max_seconds, and one column per share): the least duration that this share of the builds
    does not exceed."""
    merged = summaries.groupBy(*by).agg(
        F.sum("builds").alias("builds"),
        (F.sum("seconds") / F.sum("timed")).alias("mean_seconds"),
        F.max("longest").alias("max_seconds"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    known = F.col("max_seconds").isNotNull()  # an empty sketch has no quantiles
    quantiles = [F.when(known, F.kll_sketch_get_quantile_double("_sketch", F.lit(share))).alias(name) for name, share in shares.items()]
    return merged.select(*by, "builds", "mean_seconds", "max_seconds", *quantiles)
