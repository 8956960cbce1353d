"""Keyed state of facts over micro-batches, late pushes, restarts and compaction."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from fleetlens.session import scratch_path
from fleetlens.streaming import jobs
from fleetlens.streaming.state import fold, merge

SCHEMA = "repo bigint, type string, name string, push_id bigint, ts timestamp_ntz, sha string"
START = datetime(2024, 1, 1)


def test_late_pushes_are_told_with_their_successor():
    history, told = merge([(1, 1, "a"), (5, 5, "c")], [(3, 3, "b"), (9, 9, "c")])
    assert [p[1] for p in history] == [1, 3, 5, 9]
    assert told == [((3, 3, "b"), "a", False), ((5, 5, "c"), "b", True), ((9, 9, "c"), "c", False)]
    assert merge(history, [(3, 3, "b")]) == (history, [])  # delivered again
    assert merge([], [(2, 2, "x")])[1] == [((2, 2, "x"), None, False)]


@pytest.mark.parametrize(("watermark", "kept"), [(0, [1, 3, 5]), (1, [1, 3, 5]), (2, [1, 3, 5]), (4, [3, 5]), (99, [5])])
def test_folding_keeps_what_a_late_push_may_follow(watermark, kept):
    assert [p[0] for p in fold([(1, 1, "a"), (3, 3, "b"), (5, 5, "c")], watermark)] == kept


def expected(rows):
    """Changes and newest facts by a plain pass over all rows in the order of their events."""
    last, changes = {}, set()
    for repo, type_, name, push, ts, sha in sorted(rows, key=lambda r: (r[4], r[3], r[5])):
        before = last.get((repo, type_, name))
        if before and before[1] != sha:
            changes.add((repo, type_, name, push, before[1], sha))
        last[(repo, type_, name)] = (push, sha)
    return changes, {(*k, *v) for k, v in last.items()}


def test_waves_with_late_rows_equal_one_pass(spark):
    rng = random.Random(3)
    rows = [(p % 4, "t", f"n{rng.randrange(3)}", p, START + timedelta(hours=p), rng.choice("abc")) for p in range(240)]
    waves = [[] for _ in range(6)]
    for i, row in enumerate(rows):
        waves[min(5, i // 40 + (rng.random() < 0.2))].append(row)
    folder, location = scratch_path(spark, "in"), scratch_path(spark, "state")
    for i, wave in enumerate(waves):  # every run starts anew from the checkpoint
        spark.createDataFrame(wave + wave[:3], SCHEMA).coalesce(2).write.mode("append").parquet(folder)
        stream = jobs.read_folder_stream(spark, folder, spark.read.parquet(folder).schema)
        changes = jobs.write_changes(stream, f"{location}/a", "30 days")
        if i == 2:
            assert jobs.change_log(spark, f"{location}/a/changes").compact() >= 2
    wanted, newest = expected(rows)
    assert sorted(tuple(r) for r in changes.collect()) == sorted(wanted)
    log = jobs.change_log(spark, f"{location}/a/changes")
    log.compact()
    assert sorted(tuple(r)[:4] for r in log.read().filter("from_sha != to_sha").collect()) == sorted(w[:4] for w in wanted)
    stream = jobs.read_folder_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=2)
    assert {tuple(r) for r in jobs.write_latest(stream, f"{location}/b", "30 days").collect()} == newest


def test_pushes_behind_the_delay_are_dropped_and_dead_facts_forgotten(spark):
    folder, location = scratch_path(spark, "in"), scratch_path(spark, "state")

    def step(*rows):
        data = [(repo, "t", "n", push, START + timedelta(days=day), sha) for repo, push, day, sha in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_folder_stream(spark, folder, spark.read.parquet(folder).schema)
        return sorted(tuple(r) for r in jobs.write_changes(stream, location, "2 days", expire_days=20).collect())

    step((1, 1, 0, "a"), (2, 2, 0, "a"))
    step((1, 3, 10, "b"))
    assert step((1, 4, 5, "c"), (1, 5, 11, "c")) == [(1, "t", "n", 3, "a", "b"), (1, "t", "n", 5, "b", "c")]  # push 4 is five days late
    step((1, 6, 40, "c"))  # repository 2 has been silent for 38 days
    assert [r for r in step((2, 7, 41, "z"), (1, 8, 41, "d")) if r[0] == 2] == []


def test_a_base_without_a_mark_is_not_read(spark):
    log = jobs.latest_log(spark, scratch_path(spark, "log"))
    row = lambda push, sha: spark.createDataFrame([(1, "t", "n", push, push, sha)], log.schema)
    log.write(row(1, "a"), 0)
    assert log.compact() == 0
    log.write(row(2, "b"), 1)
    row(9, "broken").write.parquet(f"{log.location}/base/upto=1")
    assert [r.to_sha for r in log.read().collect()] == ["b"]
    assert log.compact() == 1 and log.compact() == 1
    log.write(row(3, "x"), 2)
    log.write(row(3, "c"), 2)  # a retried batch
    assert [r.to_sha for r in log.read().collect()] == ["c"]
