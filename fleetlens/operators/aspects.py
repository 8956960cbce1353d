"""Aspects: which files a kind of fact comes from, how it is read and shown.

Add your own by passing a longer list to :func:`extract_facts`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.documents import spec_json, yaml_or_json
from fleetlens.functions.payload import KEYS, no_items, with_envelope
from fleetlens.operators import extractors as x
from fleetlens.sources.files import is_exact, path_matches


@dataclass(frozen=True)
class Aspect:
    """``items`` maps one input column to an array of fact items.

    ``reads`` names that input: ``content``, ``path``, ``both``, ``document``
    (JSON text of a YAML or JSON file) or ``spec`` (canonical JSON text).
    ``display_name`` None hides the aspect from reports.
    """

    name: str
    display_name: str | None
    glob: str
    items: Callable[..., Column]
    reads: str = "content"

    def applies(self, path: Column) -> Column:
        return path_matches(path, self.glob)


NPM = Aspect(x.NPM, "NPM dependencies", "package.json", x.npm_dependencies)
NPM_COORDINATES = Aspect(x.NPM_COORDINATES, "NPM coordinates", "package.json", x.npm_coordinates)
TYPESCRIPT = Aspect(x.TYPESCRIPT, "TypeScript Version", "package.json", x.typescript_version)
TSLINT = Aspect(x.TSLINT, "TSLint", "tslint.json", x.tslint_rules)
PYTHON = Aspect(x.PYTHON, "Python dependencies", "requirements.txt", x.python_requirements)
PARENT_POM = Aspect(x.PARENT_POM, "Maven parent POM", "**/pom.xml", x.maven_parent)
MAVEN_DIRECT = Aspect(x.MAVEN_DIRECT, "Direct Maven dependencies", "pom.xml", x.maven_direct)
STARTER = Aspect(x.STARTER, "Spring Boot Starter", "pom.xml", x.spring_boot_starters)
BOOT_VERSION = Aspect(x.BOOT_VERSION, "Spring Boot Version", "pom.xml", x.spring_boot_version)
LEIN = Aspect(x.LEIN, "Clojure dependencies", "project.clj", x.lein_dependencies)
TRAVIS = Aspect(x.TRAVIS, "Travis scripts", ".travis.yml", x.travis_scripts, "document")
K8S = Aspect(x.K8S, "Kubernetes specs", "*.@(json|yaml|yml)", x.k8s_specs, "spec")
DOCKER_FROM = Aspect(x.DOCKER_FROM, "Docker base images", "**/Dockerfile", x.docker_from)
DOCKER_PATH = Aspect(x.DOCKER_PATH, "Dockerfile path", "**/Dockerfile", x.dockerfile_path, "path")
DOCKER_PORTS = Aspect(x.DOCKER_PORTS, "Exposed ports", "**/Dockerfile", x.docker_ports)
LICENSE = Aspect(x.LICENSE, "License", "LICENSE", x.licenses)
OWNERSHIP = Aspect(x.OWNERSHIP, "Code ownership", "CODEOWNERS", x.code_owners)
SECRETS = Aspect(x.SECRET, "Exposed secrets", "**", x.exposed_secrets, "both")
METRICS = Aspect(x.METRICS, "Code metrics", "src/**", x.source_lines, "both")

ASPECTS = [
    NPM, NPM_COORDINATES, TYPESCRIPT, TSLINT, PYTHON, PARENT_POM, MAVEN_DIRECT, STARTER, BOOT_VERSION, LEIN,
    TRAVIS, K8S, DOCKER_FROM, DOCKER_PATH, DOCKER_PORTS, LICENSE, OWNERSHIP, SECRETS, METRICS,
]

# Display name of every aspect by fact type; None means hidden in reports.
DISPLAY_NAMES: dict[str, str | None] = {a.name: a.display_name for a in ASPECTS} | {
    x.FRAMEWORKS: "CSProject TargetFrameworks",
    "stack": "stack",
    "javaBuild": "Java build tool",
    "ci": None,
    "csproject": None,
    "snyk": None,
    "changelog": "Changelog",
    "contributing": "Contributing",
    "azure-pipelines": "Azure pipeline",
    "readme": "Readme file",
    "code-of-conduct": "Code of conduct",
    "license-presence": "License presence",
    "branch-count": "Branch count",
    "git-recency": "Recency of git activity",
    "git-active-committers": "Active committers",
    "build-time": "Build time",
    "suggest-tag": None,
    "confirmed-tag": "Human confirmed tag",
    "maven-deps": "Maven dependency tree",
}


PARSERS: dict[str, Callable[[Column], Column]] = {"document": yaml_or_json, "spec": spec_json}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _items(rows: DataFrame, aspects: list[Aspect], keep: list[str]) -> DataFrame:
    """One narrow pass of aspects that need no parsed document, or share one."""
    path = F.col("path")

    def items(aspect: Aspect) -> Column:
        columns = [path, F.col("content")] if aspect.reads == "both" else [F.col(aspect.reads)]
        return F.coalesce(aspect.items(*columns), no_items())

    # Aspects of one exact path share a CASE branch, so a row is tested against
    # the paths until one fits and evaluates no extractor of another file.
    by_path: dict[str, list[Column]] = {}
    for aspect in aspects:
        if is_exact(aspect.glob):
            by_path.setdefault(aspect.glob, []).append(items(aspect))
    found = [F.when(a.applies(path), items(a)).otherwise(no_items()) for a in aspects if not is_exact(a.glob)]
    if by_path:
        case = F
        for exact, parts in by_path.items():
            case = case.when(path == exact, F.concat(*parts) if len(parts) > 1 else parts[0])
        found.append(case.otherwise(no_items()))
    combined = F.concat(*found) if len(found) > 1 else found[0]
    # The arrays are computed in a projection and exploded from a plain column,
    # which keeps the generator in generated code; the outer form stops Spark
    # from inferring a filter that would compute every array twice.
    exploded = rows.select(*keep, combined.alias("_items")).select(*keep, F.explode_outer("_items").alias("i"))
    return exploded.filter(F.col("i").isNotNull()).select(*keep, "i.type", "i.name", "i.data")


def fact_items(files: DataFrame, aspects: list[Aspect], keep: list[str] = KEYS) -> DataFrame:
    """(keep, type, name, data) of all aspects.

    One pass over the files for everything that is read as text, and one pass
    per parser over just the files it parses: rows that need no parser are not
    sent to Python, and a path filter on a stored files table skips the rest.
    """
    path, parts = F.col("path"), []
    text = [a for a in aspects if a.reads not in PARSERS]
    if text:
        parts.append(_items(files.filter(_any([a.applies(path) for a in text])), text, keep))
    for reads, convert in PARSERS.items():
        readers = [a for a in aspects if a.reads == reads]
        if readers:
            rows = files.filter(_any([a.applies(path) for a in readers]))
            parts.append(_items(rows.withColumn(reads, convert(F.col("content"))), readers, keep))
    return reduce(DataFrame.unionByName, parts)


def extract_facts(files: DataFrame, aspects: list[Aspect] = ASPECTS, keep: list[str] = KEYS) -> DataFrame:
    """Facts with their envelope."""
    return with_envelope(fact_items(files, aspects, keep), keep)


def rejects(files: DataFrame) -> DataFrame:
    """Files an extractor could not read: (keys, path, aspect, error). Malformed
    input never stops a job and is never lost silently."""
    path, content = F.col("path"), F.col("content")
    at_root = ~F.contains(path, F.lit("/"))
    is_json = at_root & F.endswith(path, F.lit(".json"))
    is_yaml = at_root & (F.endswith(path, F.lit(".yml")) | F.endswith(path, F.lit(".yaml")))
    broken_json = files.filter(is_json & content.isNotNull() & F.try_parse_json(content).isNull())
    # several documents in one file are no fault; they just give no fact
    one_document = ~content.rlike("(?m)^---") & (F.trim(content) != "")
    broken_yaml = files.filter(is_yaml & one_document).withColumn("_d", yaml_or_json(content)).filter("_d IS NULL").drop("_d")
    known = {"package.json": x.NPM, "tslint.json": x.TSLINT, ".travis.yml": x.TRAVIS}
    aspect = F.lit(x.K8S)
    for name, type_ in known.items():
        aspect = F.when(path == name, type_).otherwise(aspect)
    error = F.when(is_json, "not JSON").otherwise("neither YAML nor JSON")
    return broken_json.unionByName(broken_yaml).select(*KEYS, "path", aspect.alias("aspect"), error.alias("error"))


def without_hidden(facts: DataFrame) -> DataFrame:
    """Facts of aspects that reports show."""
    hidden = sorted(t for t, shown in DISPLAY_NAMES.items() if shown is None)
    return facts.filter(~F.col("type").isin(hidden))
