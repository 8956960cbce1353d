"""The fact store and the scopes an analysis runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repo_scope(repos: DataFrame, owner: str) -> DataFrame:
    return repos.filter(F.col("owner") == owner)


def incremental_scope(scope: DataFrame, stored: DataFrame, update: bool = False) -> DataFrame:
    """Snapshots still to analyse; all of them when ``update`` is set."""
    if update:
        return scope
    return scope.join(stored.select("repo", "push_id").distinct(), ["repo", "push_id"], "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The facts of the newest push per (repo, type, name) of both inputs; needs a ``ts`` column.

    A push may have several facts of one name (owners, secrets, images): all of
    them stay, equal ones once. Spark keeps only rows of rank 1 of a task before
    it shuffles, so a repository with many analyses does not fill a partition.
    """
    keys = ["repo", "type", "name"]
    both = stored.unionByName(fresh)
    age = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("push_id").desc())
    newest = both.withColumn("_rank", F.rank().over(age)).filter("_rank = 1").drop("_rank")
    return newest.dropDuplicates([*keys, "sha"])


def latest_state(facts: DataFrame, latest_pushes: DataFrame) -> DataFrame:
    """Facts of the newest default-branch push of each repo."""
    return facts.join(latest_pushes.select("repo", "push_id"), ["repo", "push_id"], "left_semi")


def write_store(facts: DataFrame, location: str) -> None:
    """Facts by type: a report over one type reads one folder."""
    facts.write.mode("append").partitionBy("type").parquet(location)


def as_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): every row as one JSON document."""
    return df.select(*keys, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("document"))


def write_documents(df: DataFrame, location: str) -> None:
    df.write.mode("append").json(location)
