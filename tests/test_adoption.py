"""Variants by month from changes, against a plain calendar."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from fleetlens.operators.reports import adoption_over_time

START = datetime(2023, 11, 20)


def test_every_month_states_all_repositories(spark):
    rng = random.Random(8)
    pushes = [(rng.randrange(25), p, START + timedelta(days=rng.randrange(400))) for p in range(160)]
    facts = [(p, "t", f"n{n}", rng.choice("abc")) for _, p, _ in pushes for n in range(3) if rng.random() < 0.7]
    facts += facts[:20]  # a fact twice
    found = adoption_over_time(
        spark.createDataFrame(facts, "push_id int, type string, name string, value string"),
        spark.createDataFrame(pushes, "repo int, push_id int, ts timestamp_ntz"),
    )
    index = lambda ts: ts.year * 12 + ts.month - 1
    expected = Counter()
    months = range(min(index(t) for _, _, t in pushes), max(index(t) for _, _, t in pushes) + 1)
    for m in months:
        for repo in {r for r, _, _ in pushes}:
            before = [(t, p) for r, p, t in pushes if r == repo and index(t) <= m]
            if before:
                for _, type_, name, value in {f for f in facts if f[0] == max(before)[1]}:
                    expected[(f"{m // 12:04d}-{m % 12 + 1:02d}", type_, name, value)] += 1
    rows = found.collect()
    assert {tuple(r)[:4]: r.repos for r in rows} == expected and len(rows) == len(expected)
    total = Counter()
    for (month, type_, name, _), n in expected.items():
        total[(month, type_, name)] += n
    assert all(abs(r.share - r.repos / total[(r.month, r.type, r.name)]) < 1e-6 for r in rows)


def test_a_later_end_and_empty_tables(spark):
    from pyspark.sql import functions as F

    pushes = spark.createDataFrame([(1, 1, START)], "repo int, push_id int, ts timestamp_ntz")
    facts = spark.createDataFrame([(1, "t", "n", "a")], "push_id int, type string, name string, value string")
    months = [r.month for r in adoption_over_time(facts, pushes, F.lit("2024-02-05").cast("date")).orderBy("month").collect()]
    assert months == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert adoption_over_time(facts.filter("false"), pushes).collect() == []
    assert adoption_over_time(facts, pushes.filter("false")).collect() == []
