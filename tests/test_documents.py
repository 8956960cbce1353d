"""Kubernetes and CI files: fixed hashes, key order, scalar-or-list fields."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import documents
from fleetlens.functions.display import display_value
from fleetlens.operators import aspects as a
from fleetlens.operators.aspects import extract_facts, rejects
from fleetlens.operators.ci import travis_profile
from fleetlens.operators.remediate import k8s_remediation
from fleetlens.plans.queries import QUERIES

# These specs and their hashes have to agree with stored facts.
SVC = "apiVersion: v1\nkind: Service\nmetadata:\n  name: providence\n  namespace: sonic-youth\n"
DEP = '{"apiVersion":"apps/v1","kind":"Deployment","metadata":{"name":"providence","namespace":"sonic-youth"}}'
SVC_SHA = "efb7bbe1f03bdc744cefbb5d150ef37c8570b159a99d5f89cca6e9ed47f5138b"
DEP_SHA = "df9e9f62024d15c7823c6eb688cf3489f3c640f2f9af892880108b385a9fa37d"
FREAK_SHA = "97658d338cf82d5962cc6212e44a4fa0e78c554a7fa12477648e88ef83e3b4b2"
FREAK = {
    "apiVersion": "v1",
    "kind": "Service",
    "metadata": {"name": "freak-scene", "namespace": "dinosaur-jr"},
    "spec": {
        "ports": [{"name": "http", "port": 8080, "targetPort": "http"}],
        "selector": {"app.kubernetes.io/name": "bug"},
    },
}
FREAK_OTHER_ORDER = {
    "spec": {
        "selector": {"app.kubernetes.io/name": "bug"},
        "ports": [{"port": 8080, "targetPort": "http", "name": "http"}],
    },
    "metadata": {"namespace": "dinosaur-jr", "name": "freak-scene"},
    "kind": "Service",
    "apiVersion": "v1",
}
LABELLED = """apiVersion: apps/v1
kind: Deployment
metadata:
  name: autumn
  labels: {app.kubernetes.io/managed-by: someone, app: autumn}
spec:
  replicas: 1.0
  template:
    metadata:
      labels:
        app.kubernetes.io/managed-by: someone
        app: autumn
"""


def specs(files_df):
    rows = extract_facts(files_df, [a.K8S]).collect()
    return {(r.repo, r.name): r for r in rows}


def test_specs_of_yaml_and_json(files):
    found = specs(files(
        k1=[("README.md", "Hello, world.\n"), ("svc.yml", SVC), ("dep.json", DEP), ("sa.json", "{}")],
        k2=[("a.json", json.dumps(FREAK))],
        k3=[("b.json", json.dumps(FREAK_OTHER_ORDER, indent=2))],
        k7=[("role.yaml", "apiVersion: rbac/v1\nkind: ClusterRole\nmetadata: {name: freak-scene}\n")],
    ))
    assert {k: v.sha for k, v in found.items() if k[0] != "k7"} == {
        ("k1", "Service::sonic-youth::providence"): SVC_SHA,
        ("k1", "Deployment::sonic-youth::providence"): DEP_SHA,
        ("k2", "Service::dinosaur-jr::freak-scene"): FREAK_SHA,
        ("k3", "Service::dinosaur-jr::freak-scene"): FREAK_SHA,
    }
    assert ("k7", "ClusterRole::freak-scene") in found
    row = found["k1", "Service::sonic-youth::providence"]
    assert (row.type, row.abbreviation, row.version) == ("k8s-specs", "k8sspecs", "0.0.1")


def test_no_specs(files):
    meta = "metadata:\n  name: x\n"
    assert not specs(files(
        k5=[("README.md", "apiVersion: v1")],
        k6=[
            ("a.yml", "kind: Service\n" + meta), ("b.yml", "apiVersion: v1\n" + meta),
            ("c.yml", "apiVersion: v1\nkind: Service\nmetadata:\n  namespace: y\n"),
            ("d.yml", "apiVersion: v1\nkind: ''\n" + meta),
        ],
        k8=[("package-lock.json", '{"name":"p","lockfileVersion":1,"dependencies":{}}')],
        k9=[
            ("empty.yml", ""), ("broken.yml", "a: [1"), ("two.yml", SVC + "---\n" + SVC), ("twice.yml", SVC + "kind: Pod\n"),
            ("deep/svc.yml", SVC),
        ],
    ))


def test_managed_by_labels_do_not_count(files):
    plain = LABELLED.replace("app.kubernetes.io/managed-by: someone, ", "").replace(
        "        app.kubernetes.io/managed-by: someone\n", ""
    )
    found = specs(files(
        a=[("d.yml", LABELLED)], b=[("d.yml", plain)],
        c=[("d.json", json.dumps({
            "spec": {"template": {"metadata": {"labels": {"app": "autumn", "app.kubernetes.io/managed-by": "me"}}}, "replicas": 1},
            "kind": "Deployment", "apiVersion": "apps/v1",
            "metadata": {"name": "autumn", "labels": {"app": "autumn", "app.kubernetes.io/managed-by": "me"}},
        }))],
    ))
    assert len({r.sha for r in found.values()}) == 1 and len(found) == 3
    assert "managed-by" not in found["a", "Deployment::autumn"].data


def test_empty_managed_by_label_is_kept(files):
    text = "apiVersion: v1\nkind: Pod\nmetadata:\n  name: x\n  labels:\n    app.kubernetes.io/managed-by: ''\n"
    (row,) = specs(files(a=[("p.yml", text)])).values()
    assert "managed-by" in row.data


def test_yaml_scalars_stay_strings(files):
    text = "apiVersion: v1\nkind: ConfigMap\nmetadata: {name: x}\ndata: {a: yes, b: 2020-01-01, c: 0123, d: true, e: ~}\n"
    (row,) = specs(files(a=[("c.yml", text)])).values()
    assert json.loads(row.data)["data"] == {"a": "yes", "b": "2020-01-01", "c": "0123", "d": True, "e": None}


def test_spec_display(files):
    df = extract_facts(files(a=[("dep.json", DEP)]), [a.K8S])
    shown = df.select(display_value(F.col("type"), F.col("name"), F.col("data"))).first()[0]
    assert shown == "Deployment/sonic-youth/providence"


def test_remediation_replaces_the_matching_file(spark, files):
    old = DEP.replace("apps/v1", "extensions/v1beta1")
    found = extract_facts(files(a=[("svc.yml", SVC), ("dep.json", old)], b=[("svc.yml", SVC)]), [a.K8S], ["repo", "push_id", "path"])
    target = spark.createDataFrame(
        [("k8s-specs", "Deployment::sonic-youth::providence", DEP)], "type string, name string, target_data string"
    )
    (row,) = k8s_remediation(found, target).collect()
    assert (row.repo, row.path, row.content) == ("a", "dep.json", DEP)
    yaml_target = target.select("type", F.lit("Service::sonic-youth::providence").alias("name"), "target_data")
    rows = k8s_remediation(found, yaml_target).collect()
    assert {r.content for r in rows} == {SVC.replace("v1\nkind: Service", "apps/v1\nkind: Deployment")}


NODE = "language: node_js\nnode_js: ['12']\n"
STEPS = """# built every night
language: node_js
node_js: ['14', 'current']
before_install: [make tools]
script: [make lint, make all]
after_success: make report
"""
CASES = {
    "plain": (NODE, {"scripts": [], "services": [], "node_js": ["12"], "addons": None}),
    "single": ("script: make check\n", {"scripts": ["make check"]}),
    "services": (NODE + "services: [mysql, redis]\nscript: [make a, make b, make c]\n", {"services": ["mysql", "redis"], "scripts": ["make a", "make b", "make c"]}),
    "json": ('{"node_js": "10", "script": ["make x"], "services": ["etcd"]}', {"services": ["etcd"], "scripts": ["make x"], "node_js": ["10"]}),
    "steps": (
        STEPS,
        {
            "after_success": ["make report"], "node_js": ["14", "current"], "only": None, "except": None,
            "before_install": ["make tools"], "language": "node_js",
        },
    ),
    "env": ("env: [MODE=fast, REGION=eu]\nlanguage: go", {"services": [], "addons": None, "language": "go"}),
    "addons": ('addons: {chrome: "stable"}\n', {"addons": '{"chrome":"stable"}'}),
    "jdk": ("jdk: [zulu11]", {"node_js": [], "language": None}),
    "only": ("branches: {only: [trunk, release]}", {"only": ["trunk", "release"], "except": []}),
    "except": ("branches: {except: [spike]}", {"except": ["spike"], "only": []}),
    # a doubled key: the last one wins
    "both": ("branches: {except: [spike]}\nbranches: {only: [trunk]}", {"only": ["trunk"], "except": []}),
}


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [(name, 1, ".travis.yml", text) for name, (text, _) in CASES.items()]
    rows += [("none", 1, "README.md", "x"), ("bad", 1, ".travis.yml", "a: [1")]
    df = spark.createDataFrame(rows, "repo string, push_id bigint, path string, content string")
    return df, {r.repo: r for r in travis_profile(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_travis_profile(profiles, name):
    row = profiles[1][name]
    for field, expected in CASES[name][1].items():
        assert row[field] == expected, field


def test_travis_missing_and_unreadable(profiles):
    df, found = profiles
    assert "none" not in found and "bad" not in found
    assert [(r.repo, r.aspect) for r in rejects(df).collect()] == [("bad", "travis-scripts")]


def test_travis_fact_without_scripts(profiles):
    facts = {r.repo: r for r in extract_facts(profiles[0], [a.TRAVIS]).collect()}
    assert facts["plain"].data == "[]" and facts["single"].data == '["make check"]'
    assert facts["plain"].abbreviation is None


def test_document_and_spec_come_from_one_reading(spark):
    texts = [
        '{"kind":"A","metadata":{"labels":{"app.kubernetes.io/managed-by":"x","a":"b"}}}', "kind: A\nmetadata:\n  name: n\n", "a: 1\na: 2\n",
        '{"a":1,"a":2}', "a: [", None, "", "1.50", '{"a":1.50}', "a: &x {app: 1}\nb: *x\n", "? [1]\n: 2\n", "1: a\nb: c\n", "2001-01-01: .inf\n",
        'metadata: {labels: {"app.kubernetes.io/managed-by": x}}\n',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    apart = rows.select("i", documents.yaml_or_json(F.col("content")).alias("document"), documents.spec_json(F.col("content")).alias("spec"))
    assert sorted(documents.with_document_and_spec(rows).drop("content").collect()) == sorted(apart.collect())


def test_k8s_normalise_reads_a_file_once(spark, capsys):
    QUERIES["k8s_normalise"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and plan.count("lineitem.parquet") == 1
