"""Tasks that render files follow the number of line items."""

from __future__ import annotations


from pyspark.sql import functions as F

from fleetlens.sources import driver
from fleetlens.sources.driver import Fleet


def test_rendering_tasks_follow_the_line_items(spark, tmp_path, monkeypatch):
    lines = [(push, 1 + push % 3, n, 1.0) for push in range(1, 401) for n in range(2)]
    tables = {
        "orders": spark.range(1, 401).select(
            (F.col("id") % 40).alias("o_custkey"), F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"),
            F.lit("1995-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority"),
        ),
        "lineitem": spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double"),
        "part": spark.createDataFrame(
            [(1, "LARGE", "Brand#7", 5), (2, "ECONOMY", "Brand#3", 6), (3, "LARGE", "Brand#9", 7)], "p_partkey bigint, p_type string, p_brand string, p_size int"
        ),
    }
    for name, table in tables.items():
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    fleet = Fleet(spark, str(tmp_path))
    kinds = ["package.json", "Dockerfile"]
    few = sorted(map(str, fleet.files(kinds).collect()))
    monkeypatch.setattr(driver, "LINES_PER_TASK", 20)  # 800 line items
    for scope in (None, fleet.latest_pushes()):
        for entries in (fleet.manifest_lines(scope), fleet.brand_lines(scope)):
            assert entries.rdd.getNumPartitions() >= 40
    assert sorted(map(str, fleet.files(kinds).collect())) == few
    assert len(few) == 400 + 266
