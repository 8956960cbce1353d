"""Stored sketches against exact counts and quantiles."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import sketches
from fleetlens.session import scratch_path

START = datetime(2024, 1, 15)


def facts(spark, rows, variants, months=6):
    return spark.range(rows, numPartitions=8).select(
        F.lit("t").alias("type"),
        F.concat(F.lit("n"), F.col("id") % 2).alias("name"),
        F.concat(F.lit("o"), F.col("id") % 3).alias("owner"),
        F.sha2((F.xxhash64("id") % variants).cast("string"), 256).alias("sha"),
        F.make_dt_interval(F.col("id") % months * 30).alias("d"),
    ).withColumn("ts", F.lit(START).cast("timestamp_ntz") + F.col("d")).drop("d")


@pytest.mark.parametrize("variants", [3, 200, 5_000, 60_000])
def test_merged_variants_are_close_to_exact_ones(spark, variants):
    df, location = facts(spark, 200_000, variants).cache(), scratch_path(spark, "sketches")
    half = F.xxhash64("sha", "ts", "owner") % 2 == 0
    for part in (df.filter(half), df.filter(~half)):  # cells arrive in parts
        sketches.append(sketches.variant_sketches(part), location)
    stored = sketches.stored(spark, location)
    for by, rows, cells in (
        (["type", "name"], df, stored),
        (["owner"], df, stored),
        (["name"], df.filter(sketches.month(F.col("ts")).between("2024-02", "2024-03")), sketches.between(stored, "2024-02", "2024-03")),
    ):
        exact = {tuple(r[c] for c in by): (r.uses, r.n) for r in rows.groupBy(*by).agg(F.count("*").alias("uses"), F.count_distinct("sha").alias("n")).collect()}
        for r in sketches.variants(cells, by).collect():
            uses, n = exact.pop(tuple(r[c] for c in by))
            assert r.uses == uses and abs(r.variants - n) <= (0 if n < 100 else 5 * 0.0163 * n)
        assert not exact
    folded = sketches.compact(stored, sketches.VARIANT_CELL)
    assert folded.count() == folded.select(sketches.VARIANT_CELL).distinct().count() < stored.count()
    before = {r.name: r.variants for r in sketches.variants(stored, ["name"]).collect()}
    assert all(abs(r.variants - before[r.name]) <= (0 if r.variants < 100 else 0.1 * r.variants) for r in sketches.variants(folded, ["name"]).collect())
    df.unpersist()


def test_a_cell_has_a_bounded_size(spark):
    sizes = [sketches.variant_sketches(facts(spark, n, n, 1)).agg(F.max(F.length("sketch"))).first()[0] for n in (30_000, 300_000)]
    assert max(sizes) < 10_000
    builds = [(1, START, float(x)) for x in range(40_000)]
    found = sketches.build_sketches(spark.createDataFrame(builds, "repo int, ts timestamp_ntz, value double"))
    assert found.agg(F.max(F.length("sketch"))).first()[0] < 10_000


def test_merged_quantiles_are_close_to_exact_ones(spark):
    rng = np.random.default_rng(2)
    values = [(int(r), START + timedelta(days=int(d)), float(v)) for r, d, v in zip(rng.integers(0, 3, 30_000), rng.integers(0, 200, 30_000), rng.gamma(2, 90, 30_000), strict=True)]
    values += [(9, START, None), (8, START, 5.0), (8, START, None)]
    location = scratch_path(spark, "sketches")
    df = spark.createDataFrame(values, "repo int, ts timestamp_ntz, value double")
    sketches.append(sketches.build_sketches(df.filter("value < 100")), location)
    sketches.append(sketches.build_sketches(df.filter("value >= 100 OR value IS NULL")), location)
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    found = {r.repo: r for r in sketches.build_quantiles(sketches.stored(spark, location), ["repo"], shares).collect()}
    assert (found[9].builds, found[9].mean_seconds, found[9].max_seconds, found[9].p50) == (1, None, None, None)
    assert (found[8].builds, found[8].mean_seconds, found[8].p50, found[8].p99) == (2, 5.0, 5.0, 5.0)
    for repo in range(3):
        exact = np.sort([v for r, _, v in values if r == repo])
        for name, share in shares.items():
            assert abs(np.searchsorted(exact, found[repo][name]) / len(exact) - share) < 0.03
        assert found[repo].max_seconds == exact[-1] and abs(found[repo].mean_seconds - exact.mean()) < 1e-6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "type string, name string, owner string, sha string, ts timestamp_ntz")
    assert sketches.variants(sketches.variant_sketches(empty), ["name"]).collect() == []
