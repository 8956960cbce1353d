"""Maven models and resolution against a plain resolver."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.maven import effective_models, pom_model, resolve

FULL = """<?xml version="1.0"?>
<project>
  <parent><groupId>org.x</groupId> <artifactId>parent</artifactId>
    <version>3</version></parent>
  <artifactId>app</artifactId>
  <!-- <dependency><groupId>no</groupId><artifactId>no</artifactId></dependency> -->
  <properties><a.version> 1.5 </a.version><b>${a.version}</b></properties>
  <dependencyManagement><dependencies>
    <dependency><groupId>m</groupId><artifactId>n</artifactId><version>9</version><scope>test</scope></dependency>
  </dependencies></dependencyManagement>
  <dependencies>
    <dependency><groupId>g</groupId><artifactId>one</artifactId><version>${b}</version><optional>true</optional>
      <exclusions><exclusion><groupId>e</groupId><artifactId>f</artifactId></exclusion><exclusion><groupId>h</groupId></exclusion></exclusions></dependency>
    <dependency><groupId>m</groupId><artifactId>n</artifactId></dependency>
    <dependency><groupId>${project.groupId}</groupId><artifactId>own</artifactId><version>${project.version}</version></dependency>
    <dependency><artifactId>broken</artifactId></dependency>
  </dependencies>
  <build><plugins><plugin><dependencies><dependency><groupId>p</groupId><artifactId>q</artifactId></dependency></dependencies></plugin></plugins></build>
</project>"""


def poms(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "content string")


def test_model_of_a_pom(spark):
    m = poms(spark, FULL).select(pom_model(F.col("content")).alias("m")).first()["m"]
    assert (m.group, m.artifact, m.version, tuple(m.parent)) == ("org.x", "app", "3", ("org.x", "parent", "3"))
    assert [tuple(p) for p in m.properties] == [("a.version", "1.5"), ("b", "${a.version}")]
    assert [(d.group, d.artifact, d.version, d.scope) for d in m.managed] == [("m", "n", "9", "test")]
    assert [(d.artifact, d.optional, d.exclusions) for d in m.dependencies][:2] == [("one", True, ["e:f", "h:*"]), ("n", None, [])]
    assert [d.artifact for d in m.dependencies] == ["one", "n", "own"]


def test_effective_model(spark):
    parent = "<project><groupId>org.x</groupId><artifactId>parent</artifactId><version>3</version><properties><b>7</b><c>8</c></properties><dependencies><dependency><groupId>g</groupId><artifactId>common</artifactId><version>${c}</version></dependency></dependencies></project>"
    found = {r.id: r for r in effective_models(poms(spark, FULL, parent, parent, "", None, "<project/>")).collect()}
    assert sorted(found) == ["org.x:app:3", "org.x:parent:3"]
    deps = [(d.group, d.artifact, d.version, d.scope) for d in found["org.x:app:3"].dependencies]
    assert deps == [("g", "one", "1.5", "compile"), ("m", "n", "9", "test"), ("org.x", "own", "3", "compile"), ("g", "common", "8", "compile")]


def chain(i, parent, extra=""):
    up = f"<parent><groupId>g</groupId><artifactId>p{parent}</artifactId><version>1</version></parent>" if parent is not None else ""
    return f"<project>{up}<groupId>g</groupId><artifactId>p{i}</artifactId><version>1</version><properties><v{i}>{i}</v{i}><all>{i}</all></properties>{extra}</project>"


def test_long_and_circular_parents_end(spark):
    use = "<dependencies>" + "".join(f"<dependency><groupId>d</groupId><artifactId>a{i}</artifactId><version>${{v{i}}}-${{all}}</version></dependency>" for i in (0, 9, 20)) + "</dependencies>"
    texts = [chain(i, i + 1 if i < 20 else None, use if i == 0 else "") for i in range(21)]
    texts += [chain("x", "y", use.replace("v20", "vy")), chain("y", "z"), chain("z", "x"), chain("self", "self"), chain("lost", "gone")]
    found = {r.artifact: r for r in effective_models(poms(spark, *texts)).collect()}
    assert [d.version for d in found["p0"].dependencies] == ["0-0", "9-0", "20-0"]
    assert found["px"].dependencies[2].version == "y-x" and len(found) == 26


def render(key, deps, managed=()):
    g, a, v = key

    def one(d):
        excluded = "".join(f"<exclusion><groupId>{x}</groupId><artifactId>{y}</artifactId></exclusion>" for x, y in d["excluded"])
        return f"<dependency><groupId>{d['g']}</groupId><artifactId>{d['a']}</artifactId><version>{d['v']}</version><scope>{d['scope']}</scope><optional>{str(d['optional']).lower()}</optional><exclusions>{excluded}</exclusions></dependency>"

    held = "".join(f"<dependency><groupId>{x}</groupId><artifactId>{y}</artifactId><version>{z}</version></dependency>" for x, y, z in managed)
    return f"<project><groupId>{g}</groupId><artifactId>{a}</artifactId><version>{v}</version><dependencyManagement><dependencies>{held}</dependencies></dependencyManagement><dependencies>{''.join(map(one, deps))}</dependencies></project>"


def plain(key, models):
    """Breadth first, in the order of declarations."""
    deps, managed = models[key]
    pins = {(g, a): v for g, a, v in reversed(managed)}
    taken, out, level, depth = {key[:2]}, [], [(key, "compile", frozenset())], 1
    while level:
        following, now = [], {}
        for node, outer, banned in level:
            for d in models.get(node, ([], []))[0]:
                ga = (d["g"], d["a"])
                if depth > 1 and (d["optional"] or d["scope"] not in ("compile", "runtime")):
                    continue
                if ga in banned or (ga[0], "*") in banned or ("*", "*") in banned or ga in taken or ga in now:
                    continue
                scope = d["scope"] if depth == 1 or outer == "compile" else outer
                version = pins.get(ga, d["v"]) if depth > 1 else d["v"]
                now[ga] = (version, scope)
                following.append(((*ga, version), scope, banned | set(d["excluded"])))
        out += [(*ga, version, scope, depth, depth == 1) for ga, (version, scope) in now.items()]
        taken |= set(now)
        level, depth = following, depth + 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_resolution_equals_a_plain_resolver(spark, seed):
    rng = random.Random(seed)
    keys = [("g", f"a{i}", str(v)) for i in range(9) for v in (1, 2)]
    models = {}
    for key in keys:
        deps = [
            {"g": "g", "a": f"a{i}", "v": str(rng.choice((1, 2, 3))), "scope": rng.choice(["compile"] * 4 + ["runtime", "test", "provided"]), "optional": rng.random() < 0.1,
             "excluded": [("g", rng.choice(["*", *(f"a{j}" for j in range(9))]))] if rng.random() < 0.15 else []}
            for i in rng.sample(range(9), rng.randrange(4))
        ]
        models[key] = (deps, [("g", f"a{rng.randrange(9)}", "2")] if rng.random() < 0.3 else [])
    effective = effective_models(poms(spark, *(render(k, *m) for k, m in models.items())))
    rows = resolve(effective, effective.select(F.col("id").alias("root"))).collect()
    for key in keys:
        assert sorted(tuple(r)[1:] for r in rows if r.root == ":".join(key)) == plain(key, models)


def test_nothing_to_resolve(spark):
    models = effective_models(poms(spark, chain(1, None)))
    assert resolve(models, models.select(F.col("id").alias("root"))).collect() == []
    assert resolve(models, models.filter("false").select(F.col("id").alias("root"))).collect() == []


def test_pairs_of_earlier_rounds_are_not_shuffled_again(spark, monkeypatch):
    one = lambda i: {"g": "g", "a": f"a{i + 1}", "v": "1", "scope": "compile", "optional": False, "excluded": []}
    models = effective_models(poms(spark, *(render(("g", f"a{i}", "1"), [one(i)], [("g", "a3", "1")]) for i in range(6))))
    plans, kind = [], type(models)
    join, setting = kind.join, "spark.sql.autoBroadcastJoinThreshold"

    def watch(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if how == "left_anti":
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(kind, "join", watch)
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")  # tables of any size are joined as large ones are
    try:
        rows = resolve(models, models.select(F.col("id").alias("root"))).collect()
    finally:
        spark.conf.set(setting, before)
    assert sorted((int(r.root[3]), int(r.artifact[1]), r.depth) for r in rows) == [(i, j, j - i) for i in range(6) for j in range(i + 1, 7)]
    assert len(plans) == 7 and all(len(re.findall(r"Exchange hashpartitioning\(root#\d+, group#", p)) == 1 for p in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("maven_")]
