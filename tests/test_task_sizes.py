"""Tasks that sort line items or facts follow their number, whatever the session's number of partitions is."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import targets
from fleetlens.operators.sequencing import newest_n
from fleetlens.sources import driver
from fleetlens.sources.driver import Fleet


@pytest.fixture
def no_broadcast(spark):
    """Tables of any size are joined as large ones are."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


def test_joins_of_line_items_are_dealt_like_their_rendering(spark, tmp_path, monkeypatch, no_broadcast):
    lines = [(push, 1 + (push + n) % 30, n, 1.0) for push in range(1, 401) for n in range(2)]
    lines += [(7, 1, 5, 1.0), (7, 1, 5, 1.0), (None, 2, 0, 1.0), (8, None, 0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(k, "LARGE", f"Brand#{k % 9}", k % 50) for k in [*range(1, 31), 4]] + [(None, "LARGE", "Brand#1", 1)]
    spark.createDataFrame(parts, "p_partkey bigint, p_type string, p_brand string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    scope = spark.createDataFrame([(p,) for p in [*range(1, 401, 2), 7, None]], "push_id bigint")
    rows = lambda: sorted(map(str, Fleet(spark, str(tmp_path)).part_lines(scope).collect()))
    few = rows()
    monkeypatch.setattr(driver, "LINES_PER_TASK", 20)
    assert Fleet(spark, str(tmp_path)).part_lines(scope).rdd.getNumPartitions() >= 40
    assert rows() == few
    assert len(few) > 400


def orders(spark, path):
    start = datetime(2020, 1, 1)
    rows = [(p, p % 7, "OFP"[p % 3], start + timedelta(days=p % 50), "2-HIGH") for p in range(1, 301)]
    rows += [(None, 3, "F", start + timedelta(days=90), "5-LOW"), (900, 3, "F", None, None), (901, None, "F", start, "5-LOW")]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(str(path / "orders.parquet"))
    spark.createDataFrame([(p, p, 1, 1.0) for p in range(800)], "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(path / "lineitem.parquet"))
    spark.createDataFrame([(p, "LARGE", "Brand#1", 1) for p in range(800)], "p_partkey bigint, p_type string, p_brand string, p_size int").coalesce(1).write.parquet(str(path / "part.parquet"))


def test_sorted_line_items_are_not_merged_when_the_session_has_more_partitions(spark, tmp_path, monkeypatch, no_broadcast):
    orders(spark, tmp_path)
    monkeypatch.setattr(driver, "LINES_PER_TASK", 20)
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64")  # more than the 40 tasks of the line items
    try:
        fleet = Fleet(spark, str(tmp_path))
        lines = fleet.part_lines(fleet.pushes().select("push_id"))
        assert lines.rdd.getNumPartitions() >= 40
        assert lines.count() == 300
    finally:
        spark.conf.set(setting, before)


def test_pushes_are_dealt_before_the_newest_are_sorted_out(spark, tmp_path, monkeypatch):
    orders(spark, tmp_path)
    rows = lambda: sorted(map(str, Fleet(spark, str(tmp_path)).latest_pushes().collect()))
    few = rows()
    monkeypatch.setattr(driver, "LINES_PER_TASK", 20)
    plan = Fleet(spark, str(tmp_path)).latest_pushes()._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("== Physical Plan ==") :]
    assert rows() == few
    assert len(few) == 8 and "push_id=None" in few[3]  # the newest push of repository 3 has no number


def test_newest_rows_are_dealt_before_they_are_sorted(spark):
    start = datetime(2020, 1, 1)
    pushes = spark.createDataFrame([(p % 3, p, start + timedelta(days=p % 40), p % 11) for p in range(200)] + [(None, None, None, None)] * 2, "repo bigint, push_id bigint, ts timestamp_ntz, committer bigint")
    recent = newest_n(pushes, "repo", [F.desc("ts"), F.desc("push_id")], 5)
    plan = recent._jdf.queryExecution().toString()
    assert "REPARTITION_BY_COL" in plan[plan.index("== Physical Plan ==") :]
    found = recent.collect()
    for repo in range(3):
        newest = sorted(((start + timedelta(days=p % 40), p) for p in range(200) if p % 3 == repo), reverse=True)[:5]
        assert sorted(((r.ts, r.push_id) for r in found if r.repo == repo), reverse=True) == newest
    assert sum(r.repo is None for r in found) == 2


def test_ranges_of_time_follow_the_facts(spark, monkeypatch):
    start = datetime(2020, 1, 1)
    data = [("t", f"n{i % 3}", i, start + timedelta(days=i % 97), f"d{i % 5}") for i in range(600)]
    facts = spark.createDataFrame([*data, data[0]], "type string, name string, push_id bigint, ts timestamp_ntz, data string")
    history = spark.createDataFrame([("t", f"n{n}", f"x{y}", start + timedelta(days=y)) for n in range(3) for y in (5, 40, 80)], "type string, name string, target_data string, valid_from timestamp_ntz")
    result = lambda: sorted(map(str, targets.target_asof(facts, history).collect()))
    few = result()
    dealt, cut = [], targets.cut_lineage

    def watch(df, label):
        dealt.append((label, df.rdd.getNumPartitions()))
        return cut(df, label)

    monkeypatch.setattr(targets, "cut_lineage", watch)
    monkeypatch.setattr(targets, "ROWS_PER_RANGE", 20, raising=False)
    assert result() == few and len(few) > 500
    assert dict(dealt)["asof-ranges"] >= 25
