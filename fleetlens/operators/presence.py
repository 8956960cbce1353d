"""Facts that follow from which files exist: classification and glob presence.

Rules are data. All rules are tested in one projection over paths, and a
snapshot is summed up with one flag per rule, so no list is collected and
``content`` is not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.payload import KEYS, item, with_envelope
from fleetlens.functions.text import ancestors, base_name, directory_of
from fleetlens.operators.extractors import FRAMEWORK_PATTERN, FRAMEWORKS, markup_matches
from fleetlens.sources.files import path_matches


@dataclass(frozen=True)
class Rule:
    aspect: str
    glob: str
    tags: tuple[str, ...]
    reason: str


# Which file gives which tags, and why.
CLASSIFICATION_RULES = [
    Rule("stack", "pom.xml", ("jvm",), "has Maven POM"),
    Rule("stack", "build.gradle", ("jvm",), "has build.gradle"),
    Rule("stack", "package.json", ("node",), "has package.json"),
    Rule("stack", "requirements.txt", ("python",), "has requirements.txt"),
    Rule("stack", "*.py", ("python",), "has Python files in root"),
    Rule("stack", "template.yml", ("aws", "lambda"), "has Lambda template"),
    Rule("javaBuild", "pom.xml", ("maven",), "has Maven POM"),
    Rule("javaBuild", "build.gradle", ("gradle",), "has build.gradle"),
    Rule("ci", ".travis.yml", ("travis",), "has .travis.yml"),
    Rule("ci", "Jenkinsfile", ("jenkins",), "has JenkinsFile"),
    Rule("ci", ".circleci/config.yml", ("circle",), "has .circleci/config.yml"),
    Rule("ci", "pipeline.yml", ("concourse",), "has pipeline.yml"),
]

# Glob facts by name.
GLOBS = {
    "csproject": "*.csproj",
    "snyk": ".snyk",
    "azure-pipelines": "azure-pipelines.yml",
    "readme": "README.md",
}
PRESENCE_GLOBS = {
    "changelog": "CHANGELOG.md",
    "contributing": "CONTRIBUTING.md",
    "code-of-conduct": "CODE_OF_CONDUCT.md",
    "license": "LICENSE",
}
MANIFESTS = ["package.json", "pom.xml", "build.gradle", "requirements.txt", "project.clj"]


def _flag(glob: str) -> Column:
    """Whether any file of the group matches. A max over a boolean keeps the
    aggregation in generated code with a map-side partial result."""
    return F.coalesce(F.max(path_matches(F.col("path"), glob)), F.lit(False))


def classify(files: DataFrame, rules: list[Rule] = CLASSIFICATION_RULES, keys: list[str] = KEYS) -> DataFrame:
    """One fact per snapshot and aspect with at least one met rule.

    data = {tags: sorted distinct, reasons: in rule order}.
    """
    globs = sorted({r.glob for r in rules})
    flag = {glob: f"_f{i}" for i, glob in enumerate(globs)}
    matched = files.filter(_one_of([path_matches(F.col("path"), g) for g in globs]))
    flags = matched.groupBy(*keys).agg(*[_flag(g).alias(flag[g]) for g in globs])
    facts = []
    for aspect in dict.fromkeys(r.aspect for r in rules):
        own = [r for r in rules if r.aspect == aspect]
        tags = F.array_compact(F.flatten(F.array(*[
            F.when(F.col(flag[r.glob]), F.array(*[F.lit(t) for t in r.tags])).otherwise(F.array().cast("array<string>"))
            for r in own
        ])))
        reasons = F.array_compact(F.array(*[F.when(F.col(flag[r.glob]), F.lit(r.reason)) for r in own]))
        data = F.to_json(F.struct(F.array_sort(F.array_distinct(tags)).alias("tags"), reasons.alias("reasons")))
        facts.append(F.when(F.size(tags) > 0, item(aspect, aspect, data)))
    exploded = flags.select(*keys, F.explode(F.array_compact(F.array(*facts))).alias("i"))
    return with_envelope(exploded.select(*keys, "i.type", "i.name", "i.data"), keys)


def _one_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def file_match(files: DataFrame, globs: dict[str, str] = GLOBS, keys: list[str] = KEYS) -> DataFrame:
    """One fact per snapshot and glob, also when nothing matches.

    data = {glob, matches: [{path}]}. The globs name single files or the root
    folder, so a list holds at most the root entries of one snapshot.
    """
    path = F.col("path")
    hits = {name: F.array_sort(F.collect_list(F.when(path_matches(path, g), F.struct("path")))) for name, g in globs.items()}
    grouped = files.select(*keys, "path").groupBy(*keys).agg(*[h.alias(f"m_{n}") for n, h in hits.items()])
    facts = F.array(*[
        item(n, n, F.to_json(F.struct(F.lit(g).alias("glob"), F.col(f"m_{n}").alias("matches")))) for n, g in globs.items()
    ])
    return with_envelope(grouped.select(*keys, F.explode(facts).alias("i")).select(*keys, "i.type", "i.name", "i.data"), keys)


def presence(files: DataFrame, globs: dict[str, str] = PRESENCE_GLOBS, keys: list[str] = KEYS) -> DataFrame:
    """(keys, name, present): long presence table, one row per glob."""
    flags = files.select(*keys, "path").groupBy(*keys).agg(*[_flag(g).alias(n) for n, g in globs.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("present")) for n in globs])
    return flags.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.name", "p.present")


def markup_match(files: DataFrame, glob: str, pattern: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, path, match_index, match_value) of a grammar in all files of a glob; no shuffle."""
    rows = files.filter(path_matches(F.col("path"), glob))
    found = F.posexplode(markup_matches(F.col("content"), pattern)).alias("match_index", "match_value")
    return rows.select(*keys, "path", found).withColumn("match_index", F.col("match_index").cast("bigint"))


def target_frameworks(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One fact per snapshot with its target frameworks in (path, position) order."""
    found = markup_match(files, "*.csproj", FRAMEWORK_PATTERN, keys)
    ordered = F.array_sort(F.collect_list(F.struct("path", "match_index", F.col("match_value").alias("matchValue"))))
    shown = F.transform(ordered, lambda m: F.struct(m["path"].alias("path"), m["matchValue"].alias("matchValue")))
    data = F.to_json(F.struct(F.lit("*.csproj").alias("glob"), F.col("matches")))
    return with_envelope(
        found.groupBy(*keys).agg(shown.alias("matches")).select(
            *keys, F.lit(FRAMEWORKS).alias("type"), F.lit(FRAMEWORKS).alias("name"), data.alias("data")
        ),
        keys,
    )


def license_presence(facts: DataFrame, snapshots: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Second-level fact: whether a licence fact exists, for every snapshot."""
    licensed = facts.filter(F.col("type") == "license").select(*keys).distinct().withColumn("_has", F.lit(True))
    return with_envelope(
        snapshots.select(*keys).join(licensed, keys, "left").select(
            *keys,
            F.lit("license-presence").alias("type"),
            F.lit("license-presence").alias("name"),
            F.to_json(F.struct(F.coalesce(F.col("_has"), F.lit(False)).alias("present"))).alias("data"),
        ),
        keys,
    )


def virtual_projects(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Folders that hold a manifest: (keys, project)."""
    manifest = base_name(F.col("path")).isin(MANIFESTS)
    return files.filter(manifest).select(*keys, directory_of(F.col("path")).alias("project")).distinct()


def assign_projects(files: DataFrame, projects: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, path, project): the deepest project folder above each file; the
    root (an empty name) when no folder above it is a project.

    A longest-prefix match as an equi join: a file is joined once per folder
    above it, which is bounded by the depth of its path.
    """
    above = files.select(*keys, "path", F.explode(ancestors(F.col("path"))).alias("project"))
    return (
        above.join(projects.withColumn("_found", F.lit(True)), [*keys, "project"], "left")
        .groupBy(*keys, "path")
        .agg(F.coalesce(F.max_by("project", F.when(F.col("_found"), F.length("project"))), F.lit("")).alias("project"))
    )
