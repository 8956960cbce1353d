"""Several facts of one type and name in a snapshot are all kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators.aspects import rejects
from fleetlens.operators.diff import fingerprint_diff
from fleetlens.sources.files import read_checkouts
from fleetlens.sources.store import upsert
from fleetlens.streaming.jobs import batch_changes

FACT = "repo string, push_id bigint, ts timestamp, type string, name string, sha string, data string"


def owners(spark, rows):
    facts = [("r", push, None, "code-ownership", "docs/", who, who) for push, who in rows]
    return spark.createDataFrame(facts, FACT).withColumn("ts", F.timestamp_seconds("push_id"))


def test_diff_compares_sets(spark):
    facts = owners(spark, [(1, "@a"), (2, "@a"), (2, "@b"), (3, "@a"), (3, "@b"), (3, "@c"), (3, "@d"), (4, "@a"), (4, "@b"), (4, "@c"), (4, "@e")])
    pushes = spark.createDataFrame([("r", i) for i in range(1, 5)], "repo string, push_id bigint").withColumn("ts", F.timestamp_seconds("push_id"))
    found = sorted((r.push_id, r.change, r.from_sha or "", r.to_sha or "") for r in fingerprint_diff(facts, pushes).collect())
    assert found == [(2, "added", "", "@b"), (3, "added", "", "@c"), (3, "added", "", "@d"), (4, "changed", "@d", "@e")]


def test_upsert_keeps_all_facts_of_the_newest_push(spark):
    old, new = owners(spark, [(1, "@a"), (1, "@z")]), owners(spark, [(2, "@a"), (2, "@b"), (2, "@b")])
    assert sorted((r.push_id, r.sha) for r in upsert(old, new).collect()) == [(2, "@a"), (2, "@b")]


def test_checkouts_with_binary_files(spark, tmp_path):
    (tmp_path / "me" / "app").mkdir(parents=True)
    (tmp_path / "me" / "app" / "x.png").write_bytes(b"\x89PNG\xff\xfe")
    (tmp_path / "me" / "app" / "y.txt").write_text("é")
    rows = sorted((r.owner, r.repo, r.path, r.content) for r in read_checkouts(spark, str(tmp_path)).collect())
    assert rows == [("me", "app", "x.png", None), ("me", "app", "y.txt", "é")]


def test_late_push_is_no_change_back_in_time(spark):
    columns = "repo string, type string, name string, push_id bigint, ts timestamp, sha string"
    rows = lambda *r: spark.createDataFrame([("r", "t", "n", p, None, sha) for p, sha in r], columns).withColumn("ts", F.timestamp_seconds("push_id"))
    late = batch_changes(rows((5, "e")), rows((3, "c"))).collect()
    assert [(r.push_id, r.from_sha, r.to_sha) for r in late] == [(5, "c", "e")]
    newer = batch_changes(rows((5, "e")), rows((6, "e"), (7, "f"))).collect()
    assert [(r.push_id, r.from_sha, r.to_sha) for r in newer] == [(7, "e", "f")]


def test_all_broken_documents_are_listed(files):
    df = files(p=[("bad.yml", "a: [1"), ("bad.json", "{"), ("good.yml", "a: 1"), ("two.yml", "---\na: 1\n---\nb: 2\n"), ("tslint.json", "x")])
    assert sorted((r.path, r.aspect) for r in rejects(df).collect()) == [("bad.json", "k8s-specs"), ("bad.yml", "k8s-specs"), ("tslint.json", "tslint")]
