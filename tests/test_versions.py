"""Order of versions and ranges, against tables of the published rules and a plain comparison."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.versions import base_version, drift_class, precedence, satisfies
from fleetlens.operators.targets import ideal_versions, outside_range, policy_compliance, resolved_versions, target_diff

ORDERED = [
    "0.0.0-0", "0.0.0", "0.0.1", "0.9.10", "0.10.0", "1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta",
    "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "2.0.0-0", "2.0.0", "10.0.0",
]

INSIDE = {
    "^1.2.3": ("1.2.3 1.2.4 1.9.9", "1.2.2 2.0.0 2.0.0-0 1.2.4-beta 1.2.3-beta"),
    "^0.2.3": ("0.2.3 0.2.9", "0.3.0 0.2.2 1.0.0"),
    "^0.0.3": ("0.0.3", "0.0.4 0.1.0"),
    "^1.2.x": ("1.2.0 1.9.0", "1.1.9 2.0.0"),
    "^0.0.x": ("0.0.0 0.0.9", "0.1.0"),
    "^0.0": ("0.0.7", "0.1.0"),
    "^0.x": ("0.0.0 0.9.0", "1.0.0"),
    "^1.2.3-beta.2": ("1.2.3-beta.2 1.2.3-beta.10 1.2.3 1.5.0", "1.2.3-beta.1 1.2.4-beta.2 2.0.0"),
    "~1.2.3": ("1.2.3 1.2.9", "1.3.0 1.2.2"),
    "~1.2": ("1.2.0 1.2.9", "1.3.0 1.1.0"),
    "~1": ("1.0.0 1.9.9", "2.0.0 0.9.0"),
    "~>1.2.3": ("1.2.4", "1.3.0"),
    "~1.2.3-beta.2": ("1.2.3-beta.4 1.2.3", "1.2.4-beta.4"),
    "1.x": ("1.0.0 1.99.0", "2.0.0 0.1.0"),
    "1.2.*": ("1.2.0 1.2.7", "1.3.0"),
    "1": ("1.5.0", "2.0.0"),
    "*": ("0.0.0 9.9.9", "1.0.0-alpha"),
    "": ("1.2.3", "1.0.0-rc.1"),
    "1.2.3 - 2.3.4": ("1.2.3 2.0.0 2.3.4", "1.2.2 2.3.5"),
    "1.2 - 2.3.4": ("1.2.0", "1.1.9 2.3.5"),
    "1.2.3 - 2.3": ("2.3.99", "2.4.0 1.2.2"),
    "1.2.3 - 2": ("2.99.0", "3.0.0"),
    ">1.2": ("1.3.0", "1.2.9 1.2.0"),
    ">1": ("2.0.0", "1.9.9"),
    ">=1.2.7 <1.3.0": ("1.2.7 1.2.99", "1.2.6 1.3.0 1.1.0"),
    ">= 1.2.7   < 1.3.0": ("1.2.8", "1.3.0"),
    "<=1.2": ("1.2.9 0.1.0", "1.3.0"),
    "<1.2": ("1.1.9", "1.2.0 1.2.0-rc"),
    "1.2.7 || >=1.2.9 <2.0.0": ("1.2.7 1.2.9 1.4.6", "1.2.8 2.0.0"),
    "=1.2.3": ("1.2.3", "1.2.4"),
    "v1.2.3": ("1.2.3 v1.2.3", "1.2.4"),
    ">1.2.3-alpha.3": ("1.2.3-alpha.7 1.2.3 3.4.5", "3.4.5-alpha.9 1.2.3-alpha.3"),
    "<*": ("", "0.0.0 1.0.0"),
    "1.2.3+build": ("1.2.3 1.2.3+other", "1.2.4"),
}


def test_versions_are_ordered(spark):
    shuffled = random.Random(1).sample(ORDERED, len(ORDERED))
    rows = spark.createDataFrame([(v,) for v in shuffled], "v string").orderBy(precedence(F.col("v"))).collect()
    assert [r.v for r in rows] == ORDERED
    odd = spark.createDataFrame([("1.2",), ("latest",), ("",), (None,), ("1.2.3.4",)], "v string").select(precedence(F.col("v")).alias("k")).collect()
    assert [r.k for r in odd] == [None] * 5


def test_newest_is_by_precedence_and_not_by_text(spark):
    versions = spark.createDataFrame([(v,) for v in ("9.0.0", "10.0.0-rc.2", "10.0.0-rc.10", "1.0.0", None)], "v string")
    assert versions.agg(F.max_by("v", precedence(F.col("v")))).first()[0] == "10.0.0-rc.10"


def test_ranges_follow_the_published_tables(spark):
    rows = [(r, v, want) for r, sides in INSIDE.items() for want, side in zip((True, False), sides, strict=True) for v in side.split()]
    df = spark.createDataFrame(rows, "r string, v string, want boolean").repartition(4)
    wrong = df.withColumn("got", satisfies(F.col("v"), F.col("r"))).filter("got IS DISTINCT FROM want").collect()
    assert wrong == []


@pytest.mark.parametrize("text", ["latest", "git+https://example.org/x.git", "file:../x", "workspace:*", "1.2.3.4", ">=1 latest", None])
def test_what_is_no_range_is_null(spark, text):
    df = spark.createDataFrame([(text,)], "r string").select(satisfies(F.lit("1.2.3"), F.col("r")).alias("x"))
    assert df.first()["x"] is None


def plain(range_, version):
    """Carets, tildes and comparisons of full versions, by tuples."""
    v = tuple(map(int, version.split(".")))
    for op in ("^", "~", ">=", "<=", ">", "<", ""):
        if range_.startswith(op):
            a = tuple(map(int, range_[len(op) :].split(".")))
            break
    if op == "^":
        n = next((i for i, x in enumerate(a) if x), 2)
        return v >= a and v[: n + 1] == a[: n + 1]
    if op == "~":
        return v >= a and v[:2] == a[:2]
    return {">=": v >= a, "<=": v <= a, ">": v > a, "<": v < a, "": v == a}[op]


def test_random_ranges_equal_a_plain_version(spark):
    rng = random.Random(7)
    number = lambda: ".".join(str(rng.choice([0, 0, 1, 2, 10])) for _ in range(3))
    rows = [(rng.choice(["^", "~", ">=", "<=", ">", "<", ""]) + number(), number()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "r string, v string")
    for r in df.withColumn("got", satisfies(F.col("v"), F.col("r"))).collect():
        assert r.got == plain(r.r, r.v), (r.r, r.v)


def test_base_and_drift(spark):
    cases = {"^1.2.3": "1.2.3", "~2.0": "2.0.0", ">=1.2.3 <2": "1.2.3", "7": "7.0.0", "1.x": "1.0.0", "v1.0.0-rc.1": "1.0.0-rc.1", "latest": None, "<2": None, "1.2.3 || 2": "1.2.3"}
    df = spark.createDataFrame([(r,) for r in cases], "r string").withColumn("b", base_version(F.col("r")))
    assert {r.r: r.b for r in df.collect()} == cases
    pairs = [("1.0.0", "2.0.0", "major"), ("1.0.0", "1.2.0", "minor"), ("1.0.0", "1.0.1", "patch"), ("1.0.0-a", "1.0.0", "prerelease"), ("2.0.0", "1.9.0", "none"), ("x", "1.0.0", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", drift_class(precedence(F.col("a")), precedence(F.col("b")))).collect())


NPM_FACT = "repo bigint, push_id bigint, type string, name string, data string, sha string"


def npm_facts(spark, *rows):
    return spark.createDataFrame([(i, i, "npm-project-deps", lib, f'["{lib}","{r}"]', r) for i, (lib, r) in enumerate(rows)], NPM_FACT)


def test_ranges_resolve_to_the_highest_published_version(spark):
    published = [("a", v) for v in ("1.0.0", "1.2.0", "1.10.0", "2.0.0-rc.1", "1.10.1-beta", "nonsense")] + [("b", "0.1.0")]
    facts = npm_facts(spark, ("a", "^1.1.0"), ("a", "^1.1.0"), ("a", "~1.2.0"), ("a", "latest"), ("a", ">=2.0.0-rc.0"), ("b", "^9.0.0"), ("c", "1.0.0"))
    found = resolved_versions(facts, spark.createDataFrame(published, "lib string, version string"))
    assert {(r.lib, r.range): (r.uses, r.resolved, r.newest, r.drift) for r in found.collect()} == {
        ("a", "^1.1.0"): (2, "1.10.0", "1.10.0", "none"),
        ("a", "~1.2.0"): (1, "1.2.0", "1.10.0", "minor"),
        ("a", "latest"): (1, None, "1.10.0", None),
        ("a", ">=2.0.0-rc.0"): (1, "2.0.0-rc.1", "1.10.0", "none"),
        ("b", "^9.0.0"): (1, None, "0.1.0", "none"),
        ("c", "1.0.0"): (1, None, None, None),
    }


def test_ranges_that_admit_the_target_count_and_stay(spark):
    facts = npm_facts(spark, ("a", "^1.2.0"), ("a", "^1.2.0"), ("a", "~1.2.0"), ("a", "^2.0.0"), ("a", "git://x"))
    target = spark.createDataFrame([("npm-project-deps", "a", '["a","^1.4.0"]', "^1.4.0")], "type string, name string, target_data string, target_sha string")
    row = policy_compliance(facts, target).first()
    assert (row.repos, row.on_target, row.admitted) == (5, 0, 2)
    assert sorted(r.sha for r in outside_range(target_diff(facts, target)).collect()) == ["^2.0.0", "git://x", "~1.2.0"]


def test_ideal_is_the_highest_of_those_published_together(spark):
    registry = spark.createDataFrame([("a", v, 5) for v in ("^9.0.0", "^10.0.0", "^2.0.0")] + [("a", "^99.0.0", 4)], "lib string, version string, published int")
    assert ideal_versions(npm_facts(spark, ("a", "^1.0.0")), registry).first()["ideal_data"] == '["a","^10.0.0"]'
