"""Extraction by content: equal to the full extraction, and only new contents are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import aspects as a
from fleetlens.operators.aspects import extract_facts
from fleetlens.session import scratch_path
from fleetlens.sources.content_store import ContentStore

ASPECTS = [a.PYTHON, a.DOCKER_FROM, a.DOCKER_PATH, a.K8S, a.TRAVIS]
SCHEMA = "repo string, push_id bigint, path string, content string"
K8S = "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: x\n"


def rows_of(facts):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in facts.select(sorted(facts.columns)).collect())


def test_equal_to_the_full_extraction_and_reads_only_what_is_new(spark):
    first = [("r", 1, "requirements.txt", "a==1\nb==2\n"), ("r", 1, "Dockerfile", "FROM x:1\n"), ("r", 1, "sub/Dockerfile", "FROM x:1\n"),
             ("r", 1, "deploy.yml", K8S), ("s", 1, "requirements.txt", "a==1\nb==2\n"), ("s", 1, "other.bin", None), ("s", 1, "Dockerfile", None), ("s", 1, ".travis.yml", "")]
    second = first + [(r, 2, p, "FROM x:2\n" if (r, p) == ("r", "Dockerfile") else c) for r, _, p, c in first]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store = ContentStore(spark, scratch_path(spark, "contents"), ASPECTS)
    assert store.add(frame(first)) == 6  # the equal requirements count once, a path of no aspect not at all
    assert store.add(frame(second)) == 1
    assert store.add(frame(second)) == 0
    again = ContentStore(spark, store.location, ASPECTS)  # another session
    assert rows_of(again.extract(frame(second), ["repo", "push_id"])) == rows_of(extract_facts(frame(second), ASPECTS, ["repo", "push_id"]))
    assert again.extract(frame([]), ["repo", "push_id"]).collect() == []


def test_a_run_that_died_leaves_nothing(spark):
    files = spark.createDataFrame([("r", 1, "requirements.txt", "a==1\n")], SCHEMA)
    store = ContentStore(spark, scratch_path(spark, "contents"), ASPECTS)
    sha = files.select(F.sha2("content", 256)).first()[0]
    dead = [("requirements.txt", sha, "python-direct-dep", "half", "half==1", "dead")]
    spark.createDataFrame(dead, "path string, content_sha string, type string, name string, data string, run string").write.parquet(f"{store.location}/facts")
    assert [r.name for r in store.extract(files, ["repo"]).collect()] == ["a"]
    spark.createDataFrame([("requirements.txt", sha, "zz")], "path string, content_sha string, run string").write.mode("append").parquet(f"{store.location}/addresses")
    assert [r.name for r in store.extract(files, ["repo"]).collect()] == ["a"]
