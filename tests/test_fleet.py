"""Sequencing, diffs, policy, closure, tags, scores, streams and plans."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import scores as s
from fleetlens.operators import sequencing
from fleetlens.operators import tags as t
from fleetlens.operators.closure import transitive_dependencies
from fleetlens.operators.diff import fingerprint_diff
from fleetlens.operators.targets import modal_targets, target_asof, upsert_targets
from fleetlens.plans.queries import QUERIES
from fleetlens.session import scratch_path, shared_dir
from fleetlens.sources.driver import Fleet
from fleetlens.sources.store import upsert
from fleetlens.streaming import jobs

SF = "/root/testdata/sf0.001"
DAY0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows; many ties in time."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"r{rng.randrange(9)}", i, DAY0 + timedelta(hours=rng.randrange(900))) for i in range(3000)]
    return spark.createDataFrame(rows, "repo string, push_id bigint, ts timestamp_ntz")


def test_numbering_equals_a_window(skewed):
    numbered = sequencing.number_rows(skewed, "repo", ["ts", "push_id"])
    w = Window.partitionBy("repo").orderBy("ts", "push_id")
    plain = skewed.withColumn("seq", F.row_number().over(w).cast("bigint")).withColumn(
        "n", F.count("*").over(Window.partitionBy("repo"))
    )
    columns = ["repo", "push_id", "seq", "n"]
    assert sorted(map(tuple, numbered.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_trailing_frames_cross_blocks(skewed, monkeypatch):
    monkeypatch.setattr(sequencing, "BUCKET_ROWS", 16)
    numbered = sequencing.number_rows(skewed, "repo", ["ts", "push_id"])
    framed = sequencing.trailing_frame(numbered, "repo", 5, {"m": F.sum("push_id")})
    w = Window.partitionBy("repo").orderBy("ts", "push_id").rowsBetween(-4, 0)
    plain = skewed.withColumn("m", F.sum("push_id").over(w))
    columns = ["repo", "push_id", "m"]
    assert sorted(map(tuple, framed.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_newest_n_limits_before_the_shuffle(skewed):
    newest = sequencing.newest_n(skewed, "repo", [F.desc("ts"), F.desc("push_id")], 30)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert newest.groupBy("repo").count().agg(F.max("count")).first()[0] == 30


def test_diff_between_pushes(spark):
    pushes = spark.createDataFrame(
        [("a", p, DAY0 + timedelta(days=p)) for p in (1, 2, 3)] + [("b", 9, DAY0)], "repo string, push_id bigint, ts timestamp_ntz"
    )
    facts = spark.createDataFrame(
        [("a", 1, "t", "x", "1"), ("a", 1, "t", "y", "1"), ("a", 2, "t", "x", "2"), ("b", 9, "t", "x", "1")],
        "repo string, push_id bigint, type string, name string, data string",
    ).withColumn("sha", F.col("data"))
    rows = {(r.push_id, r.name): (r.change, r.from_sha, r.to_sha) for r in fingerprint_diff(facts, pushes).collect()}
    assert rows == {(2, "x"): ("changed", "1", "2"), (2, "y"): ("removed", "1", None), (3, "x"): ("removed", "2", None)}


def test_targets(spark):
    facts = spark.createDataFrame([("t", "x", d) for d in "bbaac"], "type string, name string, data string").withColumn("sha", F.col("data"))
    assert modal_targets(facts).first().target_data == "a"
    dated = "type string, name string, target_data string, target_sha string, valid_from date"
    old = spark.createDataFrame([("t", "x", "1", "1", DAY0.date()), ("t", "y", "1", "1", DAY0.date())], dated)
    new = spark.createDataFrame([("t", "x", "2", "2", (DAY0 + timedelta(days=400)).date())], dated)
    after = upsert_targets(old, new)
    assert {r.name: r.target_data for r in after.collect()} == {"x": "2", "y": "1"}
    pushed = spark.createDataFrame(
        [(i, "t", "x", DAY0 + timedelta(days=i)) for i in (-1, 0, 399, 400, 900)], "id int, type string, name string, ts timestamp_ntz"
    )
    history = old.unionByName(new).select("type", "name", "target_data", "valid_from")
    as_of = F.lit(DAY0 + timedelta(days=900)).cast("timestamp_ntz")
    assert {r.id: r.target_data for r in target_asof(pushed, history, as_of).collect()} == {0: "1", 399: "1", 400: "2", 900: "2"}


def test_upsert_keeps_the_newest(spark):
    schema = "repo string, type string, name string, push_id bigint, ts timestamp_ntz, sha string"
    stored = spark.createDataFrame([("a", "t", "x", 1, DAY0, "1"), ("a", "t", "y", 1, DAY0, "1")], schema)
    fresh = spark.createDataFrame([("a", "t", "x", 2, DAY0 + timedelta(1), "2"), ("b", "t", "x", 3, DAY0, "3")], schema)
    assert {(r.repo, r.name): r.sha for r in upsert(stored, fresh).collect()} == {("a", "x"): "2", ("a", "y"): "1", ("b", "x"): "3"}


def test_closure_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "src string, dst string")
    found = {(r.src, r.dst): r.depth for r in transitive_dependencies(edges).collect()}
    assert found["a", "d"] == 2 and found["a", "e"] == 3 and found["a", "a"] == 3 and found["d", "b"] == 2
    assert len(found) == 4 * 5


def test_line_count_limits(spark):
    counts = [199, 200, 2999, 3000, 10000, 10001]
    df = spark.createDataFrame([(n, n) for n in counts], "repo int, lines int")
    found = {r.repo: r.tag for r in t.tag_repos(df, t.LINE_TAGS).collect()}
    assert found == {199: "tiny (<200)", 3000: "big (3-10k)", 10000: "big (3-10k)", 10001: "huge (>10k)"}


def test_user_tag_and_parameters(spark):
    df = spark.createDataFrame([(1, 21, 366, 3), (2, 20, 2, 3), (3, 1, 3, 9)], "repo int, branches int, days int, committers int")
    conditions = t.branching_tags() | t.dead_tags() | t.hot_tags() | {"busy": F.col("committers") > 5}
    assert sorted(map(tuple, t.tag_repos(df, conditions).collect())) == [(1, "dead"), (1, "excessive-branches"), (2, "hot"), (3, "busy")]


def test_push_scores(spark):
    rows = [(0, None), (1, []), (2, ["a", "b"]), (3, [str(i) for i in range(100)]), (4, ["pom.xml"]), (5, ["a/pom.xml"])]
    df = spark.createDataFrame([(i, i, f) for i, f in rows], "repo int, push_id int, files_changed array<string>")
    found = {r.push_id: (r.file_change, r.pom_changed, r.risk) for r in s.commit_risk(df).collect()}
    assert found == {0: (1, 1, 1), 1: (1, 1, 1), 2: (2, 1, 1.5), 3: (5, 1, 3), 4: (1.5, 5, 3.25), 5: (1.5, 1, 1.25)}


def test_scores_ignore_missing_opinions(spark):
    rows = [("a", "x", 2.0), ("a", "y", None), ("a", "z", 5.0), ("b", "x", 5.0), ("c", "x", 3.5)]
    df = spark.createDataFrame(rows, "repo string, scorer string, score double")
    assert {r.repo: (r.total_score, r["rank"]) for r in s.total_scores(df).collect()} == {"a": (3.5, 2), "b": (5.0, 1), "c": (3.5, 2)}


def test_stream_changes_across_batches(spark):
    """The state survives between runs of the query; event order holds inside a batch."""
    folder, location = scratch_path(spark, "in"), scratch_path(spark, "changes")
    schema = "repo bigint, type string, name string, push_id bigint, ts timestamp_ntz, sha string"

    def step(rows):
        data = [(1, "t", n, p, DAY0 + timedelta(hours=p), sha) for n, p, sha in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
        return jobs.write_changes(jobs.read_folder_stream(spark, folder, schema), location)

    step([("x", 2, "b"), ("x", 1, "a"), ("y", 1, "a")])
    changes = step([("x", 3, "b"), ("x", 4, "c"), ("y", 2, "z")])
    found = sorted((r.name, r.push_id, r.from_sha, r.to_sha) for r in changes.collect())
    assert found == [("x", 2, "a", "b"), ("x", 4, "b", "c"), ("y", 2, "a", "z")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {n for n in QUERIES if n.startswith(("stream_", "push_stream", "maven_all"))}))
def test_plans_have_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = {
        "travis_scripts", "travis_profile", "yaml_or_json_ingest", "k8s_specs", "k8s_normalise", "k8s_remediation", "rejects",
        "fingerprint_envelope", "display_value", "display_name", "diff_summary", "repo_tags", "tags_by_type", "tag_counts",
        "repo_scores", "repo_total_score", "repo_profile", "canonical_sha",
    }
    assert ("ArrowEvalPython" in plan) <= (name in python)


def test_path_filter_and_columns_reach_the_scan(spark):
    path = scratch_path(spark, "files")
    Fleet(spark, SF).files(["package.json", "pom.xml"]).write.parquet(path)
    from fleetlens.operators import aspects as a
    from fleetlens.operators.aspects import extract_facts
    from fleetlens.operators.presence import presence

    stored = spark.read.parquet(path)
    plan = plan_of(extract_facts(stored, [a.NPM]))
    assert "EqualTo(path,package.json)" in plan and "Exchange" not in plan
    assert "content" not in plan_of(presence(stored)).split("ReadSchema")[1]


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)
