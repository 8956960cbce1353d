"""As-of join of facts and targets against a plain version."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from fleetlens.operators import targets
from fleetlens.operators.targets import target_asof

START = datetime(2020, 1, 1)
FACTS = "type string, name string, repo int, ts timestamp_ntz"
HISTORY = "type string, name string, target_data string, valid_from date"


def test_asof_equals_a_plain_version_and_spreads_a_hot_name(spark, monkeypatch):
    rng = random.Random(4)
    facts = [("t", "hot" if i % 3 else f"n{rng.randrange(9)}", i, START + timedelta(hours=rng.randrange(24 * 900))) for i in range(6000)]
    facts += [("t", "hot", -1 - i, START + timedelta(days=500)) for i in range(600)] + [("t", None, 1, START), ("t", "none", 1, None), ("t", "n1", 7, None)]
    history = [("t", n, f"v{i}", date(2020, 1, 1) + timedelta(days=rng.randrange(950))) for i, n in enumerate(["hot"] * 40 + [f"n{j}" for j in range(8)] * 3)]
    history += [("t", "hot", "w", date(2021, 5, 15)), ("t", "hot", "x", date(2021, 5, 15))]  # the greater one of a day counts
    ranges = []
    write = targets.cut_lineage

    def kept(df, label):
        out = write(df, label)
        ranges.append(out.groupBy("name", "_range").count().collect())
        return out

    monkeypatch.setattr(targets, "cut_lineage", kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would be put together
    try:
        found = target_asof(spark.createDataFrame(facts, FACTS), spark.createDataFrame(history, HISTORY))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.columns == ["type", "name", "repo", "ts", "target_data", "valid_from"]
    expected = []
    for type_, name, repo, ts in facts:
        valid = [(h[3], h[2]) for h in history if ts and h[1] == name and datetime.combine(h[3], datetime.min.time()) <= ts]
        if valid:
            since, data = max(valid)
            expected.append((type_, name, repo, ts, data, since))
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    assert len([r for r in ranges[0] if r.name == "hot"]) >= 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_asof_of_empty_tables(spark):
    none, facts = spark.createDataFrame([], HISTORY), [("t", "x", 1, START)]
    assert target_asof(spark.createDataFrame(facts, FACTS), none).collect() == []
    assert target_asof(spark.createDataFrame([], FACTS), none).collect() == []
