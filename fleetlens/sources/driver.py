"""The given star-schema tables read as a fleet of repositories.

repo = customer, owner = nation, workspace = region, push = order, manifest
line = line item with its part, delivery event = event, text file = document,
markup file = page. File contents are rendered by Spark from the line items of
a push, so every job sees real manifests and the expected facts can be stated
on the base tables alone.

A render aggregates line items to one row per (push, type, brand) before it
collects them into a text, so the collected group is bounded by the number of
brands, however many line items a push has. Line items are dealt by push to a
number of tasks that follows their count: a text takes far more memory than the
shuffled rows it comes from, so tasks merged by shuffled bytes would be too big.
The joins before it sort line items, so their tasks follow the count as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the stand-in fleet.
BRANCHES = {"F": "master", "O": "develop"}
DEFAULT_STATUS = "F"
KNOWN_LIBRARIES = {
    "Brand#1": "typescript",
    "Brand#2": "tslint",
    "Brand#3": "react",
    "Brand#4": "@angular/core",
    "Brand#5": "mocha",
    "Brand#6": "chai",
}
# Changed file per part type, in sorted order of the file.
CHANGED = [
    (".travis.yml", "MEDIUM"),
    ("Dockerfile", "LARGE"),
    ("README.md", "STANDARD"),
    ("package.json", "ECONOMY"),
    ("pom.xml", "PROMO"),
    ("requirements.txt", "SMALL"),
]
# Files that come with the priority of a push.
MIT_TEXT = "MIT License\n\nPermission is hereby granted, free of charge, to any person"
APACHE_TEXT = "Apache License\nVersion 2.0, January 2004\n"
PRIORITY_FILES = {
    "1-URGENT": [("LICENSE", MIT_TEXT)],
    "2-HIGH": [
        ("LICENSE", APACHE_TEXT),
        (".circleci/config.yml", "version: 2\n"),
        ("CODEOWNERS", "# owners\n* @fleet/all\ndocs/ @fleet/docs @fleet/web\n"),
    ],
    "3-MEDIUM": [("CHANGELOG.md", "# Changelog\n"), ("Jenkinsfile", "pipeline {}\n")],
    "4-NOT SPECIFIED": [
        ("CONTRIBUTING.md", "# Contributing\n"),
        ("CODE_OF_CONDUCT.md", "# Code of Conduct\n\nBe kind.\n"),
        (".snyk", "version: v1\n"),
        ("template.yml", "Transform: serverless\n"),
    ],
    "5-LOW": [("azure-pipelines.yml", "trigger: none\n"), ("build.gradle", "plugins {}\n"), ("setup.py", "setup()\n")],
}
SOURCE_EXTENSION = {"PROMO": "java", "ECONOMY": "ts", "SMALL": "py", "MEDIUM": "yml", "LARGE": "sh", "STANDARD": "ps1"}
LINES_PER_UNIT = 20
# Line items a task renders.
LINES_PER_TASK = 1 << 18
# Tasks a core for line items that the session may deal by itself.
SESSION_TASKS = 4
FAMILIES, PLATFORMS = 50, 5

PACKAGE_JSON = "package.json"
LINE_KINDS = {
    "requirements.txt": "SMALL",
    "project.clj": "SMALL",
    "pom.xml": "PROMO",
    "module/pom.xml": "PROMO",
    "App.csproj": "ECONOMY",
    "sub/Other.csproj": "ECONOMY",
    "tslint.json": "ECONOMY",
    "Dockerfile": "LARGE",
    "deploy": "LARGE",
    ".travis.yml": "MEDIUM",
    "README.md": "STANDARD",
}
PUSH_KINDS = ["priority", "config.env"]
ALL_KINDS = [PACKAGE_JSON, *LINE_KINDS, *PUSH_KINDS, "src"]


def slug(brand: Column) -> Column:
    return F.lower(F.replace(brand, F.lit("#"), F.lit("-")))


def library(type_: Column, brand: Column) -> Column:
    """Library of a part: six brands are well-known libraries, the rest are scoped."""
    out = None
    for known, lib in KNOWN_LIBRARIES.items():
        out = F.when(brand == known, F.lit(lib)) if out is None else out.when(brand == known, F.lit(lib))
    return out.otherwise(F.concat(F.lit("@"), F.lower(type_), F.lit("/"), slug(brand)))


def caret(size: Column) -> Column:
    return F.concat(F.lit("^"), size.cast("string"), F.lit(".0.0"))


@dataclass(frozen=True)
class Fleet:
    """Fleet tables of one data folder; every member is a lazy DataFrame."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def line_items(self) -> int:
        return self.table("lineitem").count()

    # --- dimensions -----------------------------------------------------

    def repos(self) -> DataFrame:
        """(repo, owner, workspace); customer never has fewer rows than nation or region,
        which are fixed at 25 and 5 rows, so Spark broadcasts those two by size."""
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").alias("repo"), F.col("n_name").alias("owner"), F.col("r_name").alias("workspace")
            )
        )

    def pushes(self) -> DataFrame:
        """(repo, push_id, branch, is_default, ts, committer, priority) from orders."""
        branch = F.lit(None)
        for status, name in BRANCHES.items():
            branch = F.when(F.col("o_orderstatus") == status, name).otherwise(branch)
        return self.table("orders").select(
            F.col("o_custkey").alias("repo"),
            F.col("o_orderkey").alias("push_id"),
            F.coalesce(branch, F.lit("feature")).alias("branch"),
            (F.col("o_orderstatus") == DEFAULT_STATUS).alias("is_default"),
            F.col("o_orderdate").alias("ts"),
            F.pmod(F.col("o_orderkey"), F.lit(7)).alias("committer"),
            F.col("o_orderpriority").alias("priority"),
        )

    def as_of(self) -> Column:
        """Newest event time of the data, as a scalar subquery; never the wall clock."""
        return self.table("orders").agg(F.max("o_orderdate")).scalar()

    # --- facts of a push --------------------------------------------------

    def part_lines(self, scope: DataFrame | None = None) -> DataFrame:
        """Line items with their part; ``scope`` restricts to the pushes it lists."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("push_id"), "l_partkey", "l_linenumber", "l_quantity"
        )
        if scope is not None:
            lines = lines.join(self.spread(scope.select("push_id"), "push_id"), "push_id", "left_semi")
        parts = self.spread(self.table("part").select("p_partkey", "p_type", "p_brand", "p_size"), "p_partkey")
        return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` (of line items, or fewer) by ``key`` over tasks of at most some ``LINES_PER_TASK`` line items."""
        tasks = -(-self.line_items // LINES_PER_TASK)
        return rows.repartition(max(tasks, self.spark.sparkContext.defaultParallelism), key)

    def spread(self, side: DataFrame, key: str) -> DataFrame:
        """``side`` of a join with line items, or pushes before they are sorted, dealt by ``key`` so that a task sorts at most
        some ``LINES_PER_TASK`` line items or their pushes; a side that is small enough is still broadcast. Up to
        ``SESSION_TASKS`` tasks a core are left to the session. More are named, else the session would merge them by their
        bytes; not fewer than its own, which it would take instead."""
        tasks = -(-self.line_items // LINES_PER_TASK)
        if tasks <= SESSION_TASKS * self.spark.sparkContext.defaultParallelism:
            return side
        return side.repartition(max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), key)

    def manifest_lines(self, scope: DataFrame | None = None) -> DataFrame:
        """(push_id, dev, lib, size): one row per manifest entry."""
        lines = self.part_lines(scope).select(
            "push_id",
            (F.pmod(F.col("l_partkey"), F.lit(2)) == 1).alias("dev"),
            library(F.col("p_type"), F.col("p_brand")).alias("lib"),
            "p_size",
        )
        return self.dealt(lines, "push_id").groupBy("push_id", "dev", "lib").agg(F.max("p_size").alias("size"))

    def pushes_with_files(self) -> DataFrame:
        """Pushes with ``files_changed``; null where a push has no line items."""
        flags = self.part_lines().groupBy("push_id").agg(
            *[F.max((F.col("p_type") == kind)).alias(kind) for _, kind in CHANGED]
        )
        changed = F.array_compact(F.array(*[F.when(F.col(kind), F.lit(path)) for path, kind in CHANGED]))
        return self.pushes().join(flags.select("push_id", changed.alias("files_changed")), "push_id", "left")

    def latest_pushes(self) -> DataFrame:
        """Newest default-branch push per repo. The aggregation sorts what a task reads, so pushes are dealt before it; by
        push, so that a task sends one row of a repo with any number of pushes."""
        newest = F.max_by(F.struct("push_id", "branch", "ts", "priority"), F.struct("ts", "push_id"))
        pushes = self.spread(self.pushes().filter("is_default"), "push_id")
        return pushes.groupBy("repo").agg(newest.alias("p")).select("repo", "p.*")

    # --- files --------------------------------------------------------------

    def files(self, kinds: list[str] | None = None, scope: DataFrame | None = None) -> DataFrame:
        """(repo, push_id, path, content) of the wanted kinds, each table scanned once.

        ``scope`` (repo, push_id, priority) limits the snapshots before any join.
        """
        kinds = ALL_KINDS if kinds is None else kinds
        pushes = (self.pushes() if scope is None else scope).select("repo", "push_id", "priority")
        parts = []
        if PACKAGE_JSON in kinds:
            parts.append(self._package_json(pushes, scope))
        snapshot_kinds = [k for k in kinds if k in LINE_KINDS or k in PUSH_KINDS]
        if snapshot_kinds:
            parts.append(self._snapshot_files(pushes, scope, snapshot_kinds))
        if "src" in kinds:
            parts.append(self._source_files(pushes, scope))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _package_json(self, pushes: DataFrame, scope: DataFrame | None) -> DataFrame:
        entry = F.struct("lib", "size")

        def section(dev: Column) -> Column:
            return F.array_sort(F.collect_list(F.when(dev, entry)))

        per_push = (
            self.manifest_lines(scope)
            .groupBy("push_id")
            .agg(section(~F.col("dev")).alias("runtime"), section(F.col("dev")).alias("devtime"))
        )

        def block(entries: Column) -> Column:
            rows = F.transform(entries, lambda e: F.concat(F.lit('    "'), e["lib"], F.lit('": "'), caret(e["size"]), F.lit('"')))
            text = F.coalesce(F.array_join(rows, ",\n"), F.lit(""))
            return F.when(text == "", F.lit("{}")).otherwise(F.concat(F.lit("{\n"), text, F.lit("\n  }")))

        content = F.concat(
            F.lit('{\n  "name": "@fleet/repo-'), F.col("repo").cast("string"),
            F.lit('",\n  "version": "1.'), F.pmod(F.col("push_id"), F.lit(10)).cast("string"),
            F.lit('.0",\n  "dependencies": '), block(F.col("runtime")),
            F.lit(',\n  "devDependencies": '), block(F.col("devtime")), F.lit("\n}\n"),
        )
        return pushes.join(per_push, "push_id", "left").select(
            "repo", "push_id", F.lit(PACKAGE_JSON).alias("path"), content.alias("content")
        )

    def brand_lines(self, scope: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
        """(push_id, p_type, brand, size): the pre-aggregated input of the renderers."""
        lines = self.part_lines(scope)
        if types is not None:
            lines = lines.filter(F.col("p_type").isin(types))
        lines = lines.select("push_id", "p_type", slug(F.col("p_brand")).alias("brand"), "p_size")
        return self.dealt(lines, "push_id").groupBy("push_id", "p_type", "brand").agg(F.max("p_size").alias("size"))

    def _snapshot_files(self, pushes: DataFrame, scope: DataFrame | None, kinds: list[str]) -> DataFrame:
        types = sorted({LINE_KINDS[k] for k in kinds if k in LINE_KINDS})
        if types:
            groups = self.brand_lines(scope, types).groupBy("push_id").agg(
                *[
                    F.array_sort(F.collect_list(F.when(F.col("p_type") == t, F.struct("brand", "size")))).alias(t)
                    for t in types
                ]
            )
            pushes = pushes.join(groups, "push_id", "left")
        rendered = []
        for kind in kinds:
            rendered += _RENDERERS[kind]()
        # render in a projection, explode a plain column in the outer form: else
        # Spark infers a filter on the array and renders every file twice
        rows = pushes.select("repo", "push_id", F.array_compact(F.array(*rendered)).alias("_files"))
        files = rows.select("repo", "push_id", F.explode_outer("_files").alias("f")).filter(F.col("f").isNotNull())
        return files.select("repo", "push_id", "f.path", "f.content")

    def _source_files(self, pushes: DataFrame, scope: DataFrame | None) -> DataFrame:
        extension = None
        for t, ext in SOURCE_EXTENSION.items():
            extension = F.when(F.col("p_type") == t, ext) if extension is None else extension.when(F.col("p_type") == t, ext)
        path = F.concat(
            F.lit("src/part-"), F.col("l_partkey").cast("string"), F.lit("-"),
            F.col("l_linenumber").cast("string"), F.lit("."), extension,
        )
        content = F.expr(f"repeat('x\\n', int(l_quantity) * {LINES_PER_UNIT})")
        # an array of one keeps the path a plain column: filters on it would
        # otherwise be pushed into the rendering and repeat it per condition
        file = F.explode(F.array(F.struct(path.alias("path"), content.alias("content")))).alias("f")
        rendered = pushes.join(self.part_lines(scope), "push_id").select("repo", "push_id", file)
        return rendered.select("repo", "push_id", "f.path", "f.content")

    # --- other inputs -------------------------------------------------------

    def delivery_events(self) -> DataFrame:
        """(event_id, repo, ts, kind, value): builds, failures, confirmations, pushes."""
        kind = (
            F.when(F.col("event_type") == "purchase", "build")
            .when(F.col("event_type") == "error", "build-failed")
            .when(F.col("event_type") == "signup", "tag-confirmed")
            .otherwise("push")
        )
        return self.table("events").select("event_id", F.col("user_id").alias("repo"), "ts", kind.alias("kind"), "value")

    def text_files(self) -> DataFrame:
        """Documents as files: repo = source, path = docs/<id>.<lang>."""
        return self.table("documents").select(
            F.col("source").alias("repo"),
            F.lit(0).cast("bigint").alias("push_id"),
            F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"),
            F.col("text").alias("content"),
            F.col("lang").alias("language"),
        )

    def markup_files(self) -> DataFrame:
        """Pages as files: repo = host, path = path of the address plus the page id."""
        return self.table("pages").select(
            F.regexp_extract("url", "^https?://([^/]+)", 1).alias("repo"),
            F.lit(0).cast("bigint").alias("push_id"),
            F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
            F.col("html").alias("content"),
        )

    def registry(self) -> DataFrame:
        """Published library versions: one row per part."""
        return self.table("part").select(
            library(F.col("p_type"), F.col("p_brand")).alias("lib"),
            caret(F.col("p_size")).alias("version"),
            F.col("p_size").alias("published"),
        )

    def published_versions(self) -> DataFrame:
        """All versions in the registry, release candidates too: one row per part."""
        key = F.col("p_partkey")
        number = _text(F.col("p_size"), ".", key % 7, ".", key % 5)
        return self.table("part").select(
            library(F.col("p_type"), F.col("p_brand")).alias("lib"),
            F.when(key % 4 == 0, _text(number, "-rc.", key % 3)).otherwise(number).alias("version"),
        )

    def chain_poms(self) -> DataFrame:
        """(key, content): a POM per part that declares the part of half its key, its version by a property."""
        key = F.col("p_partkey")
        half = F.expr("p_partkey div 2")
        text = _text(
            "<project>\n  <groupId>com.fleet.chain</groupId><artifactId>part-", key, "</artifactId><version>1.", key % 10,
            "</version>\n  <properties><half.version>1.", half % 10, "</half.version></properties>\n  <dependencies>",
            _pom_dependency("com.fleet.chain", _text("part-", half), "${half.version}"), "</dependencies>\n</project>\n",
        )
        return self.table("part").filter("p_partkey >= 1").select(key.alias("key"), text.alias("content"))

    def family_poms(self) -> DataFrame:
        """(key, content): a POM per part, version ``key`` of one of ``FAMILIES`` artifacts, that declares the parts of
        half and of a third of its key, and the POMs of ``PLATFORMS`` parents. Platform j manages family j."""
        key, half, third = F.col("p_partkey"), F.expr("p_partkey div 2"), F.expr("p_partkey div 3")
        family = lambda k: _text("fam-", k % FAMILIES)
        shunned = F.when(key % 7 == 0, _text("<exclusions><exclusion><groupId>com.fleet</groupId><artifactId>", family(F.expr("p_partkey div 4")), "</artifactId></exclusion></exclusions>")).otherwise("")
        scope = F.when(key % 3 == 0, "<scope>test</scope>").when(key % 3 == 1, "<scope>runtime</scope>").otherwise("")
        optional = F.when(key % 11 == 0, "<optional>true</optional>").otherwise("")
        text = _text(
            "<project>\n  <parent><groupId>com.fleet</groupId><artifactId>platform-", key % PLATFORMS, "</artifactId><version>1</version></parent>\n",
            "  <!-- <dependency><groupId>com.fleet</groupId><artifactId>gone</artifactId></dependency> -->\n  <artifactId>", family(key),
            "</artifactId>\n  <version>", key, "</version>\n  <properties><half>", half, "</half><half.version>${half}</half.version></properties>\n  <dependencies>\n",
            F.when(half > 0, _pom_dependency("${fleet.group}", family(half), "${half.version}", shunned)).otherwise(""),
            F.when(third > 0, _pom_dependency("com.fleet", family(third), third.cast("string"), _text(scope, optional))).otherwise(""),
            "  </dependencies>\n  <build><plugins><plugin><dependencies>", _pom_dependency("x", "plugin", "1"), "</dependencies></plugin></plugins></build>\n</project>\n",
        )
        number = F.col("j")
        platform = _text(
            "<project><groupId>com.fleet</groupId><artifactId>platform-", number, "</artifactId><version>1</version><properties><fleet.group>com.fleet",
            "</fleet.group></properties><dependencyManagement><dependencies>", _pom_dependency("com.fleet", _text("fam-", number), _text(number + FAMILIES)),
            "</dependencies></dependencyManagement></project>\n",
        )
        parts = self.table("part").filter("p_partkey >= 1")
        numbers = parts.select((F.col("p_partkey") % PLATFORMS).alias("j")).distinct()
        return parts.select(key.alias("key"), text.alias("content")).unionByName(numbers.select(F.lit(None).cast("bigint").alias("key"), platform.alias("content")))


# --- renderers: columns over the collected (brand, size) arrays of a push ----


def _file(when: Column, path: Column | str, content: Column) -> Column:
    shown = F.lit(path) if isinstance(path, str) else path
    return F.when(when, F.struct(shown.alias("path"), content.alias("content")))


def _some(type_: str) -> Column:
    return F.size(F.coalesce(F.col(type_), F.array())) > 0


def _rows(type_: str, row, sep: str = "\n") -> Column:
    return F.array_join(F.transform(F.col(type_), row), sep)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sizes(type_: str) -> Column:
    return F.transform(F.col(type_), lambda e: e["size"])


def _requirements() -> list[Column]:
    rows = _rows("SMALL", lambda e: _text(e["brand"], " == ", e["size"], "   # pinned"))
    return [_file(_some("SMALL"), "requirements.txt", _text("# runtime requirements\n\n", rows, "\n-r other.txt\n"))]


def _project_clj() -> list[Column]:
    rows = _rows("SMALL", lambda e: _text("[", e["brand"], '/lib "1.', e["size"], '.0"]'), "\n   ")
    text = _text('(defproject app "0.1.0"\n  :dependencies [', rows, "])\n")
    return [_file(_some("SMALL") & (F.col("priority") == "3-MEDIUM"), "project.clj", text)]


def _pom() -> list[Column]:
    top, first = F.array_max(_sizes("PROMO")), F.get(F.col("PROMO"), F.lit(0))["brand"]
    boot = top % 2 == 0
    group = F.when(boot, "org.springframework.boot").otherwise("com.fleet.parents")
    artifact = F.when(boot, F.lit("spring-boot-starter-parent")).otherwise(F.concat(first, F.lit("-parent")))

    def dependency(e):
        version = F.when(e["size"] % 3 != 0, _text("\n    <version>1.", e["size"], "</version>")).otherwise("")
        kind = F.when(e["size"] > 25, "-starter").otherwise("-core")
        return _text(
            "  <dependency>\n    <groupId>com.", e["brand"], "</groupId>\n    <artifactId>", e["brand"], kind,
            "</artifactId>", version, "\n  </dependency>",
        )

    text = _text(
        "<project>\n  <parent>\n    <groupId>", group, "</groupId>\n    <artifactId>", artifact,
        "</artifactId>\n    <version>", top, ".0.0</version>\n  </parent>\n  <dependencyManagement><dependencies>",
        "<dependency><groupId>managed</groupId><artifactId>only</artifactId></dependency>",
        "</dependencies></dependencyManagement>\n  <dependencies>\n", _rows("PROMO", dependency),
        "\n  </dependencies>\n</project>\n",
    )
    return [_file(_some("PROMO"), "pom.xml", text)]


def _pom_dependency(group: str, artifact: Column | str, version: Column | str, rest: Column | str = "") -> Column:
    return _text(
        "    <dependency>\n      <groupId>", group, "</groupId>\n      <artifactId>", artifact, "</artifactId>\n      <version>", version, "</version>", rest,
        "\n    </dependency>\n",
    )


def _module_pom() -> list[Column]:
    top, first = F.array_max(_sizes("PROMO")), F.get(F.col("PROMO"), F.lit(0))["brand"]
    text = _text(
        "<project><parent><groupId>com.fleet</groupId><artifactId>root-", first, "</artifactId><version>1.", top,
        "</version></parent></project>\n",
    )
    return [_file(_some("PROMO"), "module/pom.xml", text)]


def _csproj() -> list[Column]:
    sizes = F.array_sort(F.array_distinct(_sizes("ECONOMY")))
    tag = F.when(F.size(sizes) == 1, "TargetFramework").otherwise("TargetFrameworks")
    value = F.array_join(F.transform(sizes, lambda s: _text("net", s)), ";")
    text = _text("<Project>\n  <PropertyGroup>\n    <", tag, ">", value, "</", tag, ">\n  </PropertyGroup>\n</Project>\n")
    return [_file(_some("ECONOMY"), "App.csproj", text)]


def _sub_csproj() -> list[Column]:
    text = F.lit("<Project><TargetFramework>never</TargetFramework></Project>\n")
    return [_file(_some("ECONOMY"), "sub/Other.csproj", text)]


def _tslint() -> list[Column]:
    def rule(e):
        value = (
            F.when(e["size"] % 4 == 0, F.lit("true"))
            .when(e["size"] % 4 == 1, F.lit("false"))
            .when(e["size"] % 4 == 2, e["size"].cast("string"))
            .otherwise(_text("[true, ", e["size"], "]"))
        )
        return _text('    "', e["brand"], '": ', value)

    text = _text('{\n  "extends": "tslint:recommended",\n  "rules": {\n', _rows("ECONOMY", rule, ",\n"), "\n  }\n}\n")
    return [_file(_some("ECONOMY"), "tslint.json", text)]


def _dockerfile() -> list[Column]:
    rows = _rows("LARGE", lambda e: _text("FROM registry/", e["brand"], ":", e["size"], "\nEXPOSE ", e["size"] + 8000, "/tcp"))
    return [_file(_some("LARGE"), "Dockerfile", _text("# images\n", rows, "\n"))]


def _deploy() -> list[Column]:
    """The same Deployment as JSON or YAML and with two key orders, by push."""
    name, replicas = F.get(F.col("LARGE"), F.lit(0))["brand"], F.array_max(_sizes("LARGE"))
    as_json = F.pmod(F.col("push_id"), F.lit(2)) == 0
    flipped = F.pmod(F.expr("push_id div 2"), F.lit(2)) == 1
    meta = _text(
        '"metadata": {"name": "', name, '", "namespace": "fleet", "labels": {"app": "', name,
        '", "app.kubernetes.io/managed-by": "someone"}}',
    )
    head, spec = F.lit('"apiVersion": "apps/v1", "kind": "Deployment"'), _text('"spec": {"replicas": ', replicas, "}")
    json_text = F.when(flipped, _text("{", spec, ", ", meta, ", ", head, "}")).otherwise(
        _text("{", head, ", ", meta, ", ", spec, "}")
    )
    y_meta = _text(
        "metadata:\n  name: ", name, "\n  namespace: fleet\n  labels:\n    app: ", name,
        "\n    app.kubernetes.io/managed-by: someone\n",
    )
    y_head, y_spec = F.lit("apiVersion: apps/v1\nkind: Deployment\n"), _text("spec:\n  replicas: ", replicas, "\n")
    yaml_text = F.when(flipped, F.concat(y_spec, y_meta, y_head)).otherwise(F.concat(y_head, y_meta, y_spec))
    return [
        _file(
            _some("LARGE"),
            F.when(as_json, F.lit("deploy.json")).otherwise(F.lit("deploy.yml")),
            F.when(as_json, json_text).otherwise(yaml_text),
        )
    ]


def _travis() -> list[Column]:
    script = lambda e: _text("make ", e["brand"], "-", e["size"])
    single = F.size(F.col("MEDIUM")) == 1
    one = _text("language: java\nscript: ", _rows("MEDIUM", script), "\nservices: ", _rows("MEDIUM", lambda e: e["brand"]), "\n")
    many = _text(
        "language: java\njdk:\n  - openjdk8\nscript:\n", _rows("MEDIUM", lambda e: _text("  - ", script(e))),
        "\nservices:\n", _rows("MEDIUM", lambda e: _text("  - ", e["brand"])),
        "\nbranches:\n  only:\n  - master\n",
    )
    return [_file(_some("MEDIUM"), ".travis.yml", F.when(single, one).otherwise(many))]


def _readme() -> list[Column]:
    first, top = F.get(F.col("STANDARD"), F.lit(0))["brand"], F.array_max(_sizes("STANDARD"))
    return [_file(_some("STANDARD"), "README.md", _text("# ", first, "\n", F.repeat(F.lit("words "), top)))]


def _priority() -> list[Column]:
    out = []
    for priority, files in PRIORITY_FILES.items():
        out += [_file(F.col("priority") == priority, path, F.lit(text)) for path, text in files]
    return out


def _config_env() -> list[Column]:
    key = F.upper(F.substr(F.md5(F.col("push_id").cast("string")), F.lit(1), F.lit(16)))
    return [_file(F.col("priority") == "5-LOW", "config.env", _text("REGION=eu\nKEY=AKIA", key, "\n"))]


_RENDERERS = {
    "requirements.txt": _requirements,
    "project.clj": _project_clj,
    "pom.xml": _pom,
    "module/pom.xml": _module_pom,
    "App.csproj": _csproj,
    "sub/Other.csproj": _sub_csproj,
    "tslint.json": _tslint,
    "Dockerfile": _dockerfile,
    "deploy": _deploy,
    ".travis.yml": _travis,
    "README.md": _readme,
    "priority": _priority,
    "config.env": _config_env,
}
