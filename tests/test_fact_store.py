"""The bucketed fact store: upserts, removals, dead writers, compaction and plans."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from fleetlens.session import scratch_path
from fleetlens.sources.fact_store import FactStore
from fleetlens.sources.store import upsert

SCHEMA = "repo bigint, type string, name string, push_id bigint, ts timestamp_ntz, sha string"
START = datetime(2024, 1, 1)


def facts(spark, *rows):
    return spark.createDataFrame([(r, "t", n, p, START + timedelta(days=p), s) for r, n, p, s in rows], SCHEMA)


def read(store):
    return sorted((r.repo, r.name, r.push_id, r.sha) for r in store.read().collect())


def test_upserts_removals_and_compaction(spark):
    store = FactStore(spark, scratch_path(spark, "store"), SCHEMA, 4)
    assert read(store) == []
    first = facts(spark, (1, "a", 1, "x"), (1, "a", 1, "y"), (1, "b", 1, "x"), (2, "a", 1, "x"))
    second = facts(spark, (1, "a", 3, "z"), (1, "a", 3, "z"), (3, "a", 1, "q"), (2, "a", 0, "late"))
    store.upsert(first)
    store.upsert(second)
    expected = sorted((r.repo, r.name, r.push_id, r.sha) for r in upsert(first, second).collect())
    assert read(store) == expected == [(1, "a", 3, "z"), (1, "b", 1, "x"), (2, "a", 1, "x"), (3, "a", 1, "q")]
    store.remove(facts(spark, (1, "b", 4, "")).drop("sha"))
    again = FactStore(spark, store.location, SCHEMA, 4)  # another session
    for _ in range(2):
        assert read(again) == [e for e in expected if e[1] != "b"]
        again.compact()
    assert len(again.parts()) == 1
    again.upsert(facts(spark, (1, "b", 2, "late")))  # older than its removal
    assert read(again) == [e for e in expected if e[1] != "b"]
    again.upsert(facts(spark, (1, "b", 5, "back")))
    assert (1, "b", 5, "back") in read(again)


def test_a_writer_that_dies_leaves_the_version_before(spark, monkeypatch):
    store = FactStore(spark, scratch_path(spark, "store"), SCHEMA, 4)
    store.upsert(facts(spark, (1, "a", 1, "x")))

    def die(parts):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_mark", die)
    for write in (lambda: store.upsert(facts(spark, (1, "a", 2, "y"))), store.compact):
        try:
            write()
        except RuntimeError:
            pass
    monkeypatch.undo()
    assert read(store) == [(1, "a", 1, "x")]
    store.upsert(facts(spark, (1, "a", 3, "z")))
    assert read(store) == [(1, "a", 3, "z")]


@pytest.mark.parametrize("deltas", [1, 3])
def test_stored_facts_are_not_shuffled(spark, deltas):
    store = FactStore(spark, scratch_path(spark, "store"), SCHEMA, 4)
    for i in range(deltas):
        store.upsert(facts(spark, *[(r, "a", i, f"s{r}") for r in range(50)]))
    other = spark.range(50).withColumnRenamed("id", "repo")
    joined = store.read().join(other.hint("merge"), "repo").groupBy("repo").count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(repo" in plan  # the other side only
    assert joined.count() == 50
