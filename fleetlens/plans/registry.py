"""Registered queries: a name, a job over a data folder, and its SQL statement.

The SQL reads the base tables only and states the expected result directly; it
never sees a rendered file, so it cannot repeat an error of an extractor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import prepare
from fleetlens.sources.driver import Fleet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``job(fleet) -> DataFrame`` under a name."""

    def add(job: Callable[[Fleet], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(Fleet(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return job

    return add
