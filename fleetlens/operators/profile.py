"""One wide row per repository: everything taggers and scorers ask for.

All extractors, file tests and line counts run in one narrow pass over the
files of the newest snapshots; one aggregation per repository sums them up.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.payload import item
from fleetlens.functions.text import directory_of
from fleetlens.operators import aspects as a
from fleetlens.operators import extractors as x
from fleetlens.operators.delivery import active_committers, branch_count, git_recency
from fleetlens.operators.presence import GLOBS, MANIFESTS, PRESENCE_GLOBS

FILE = "file"
MANIFEST = "manifest"
README_LENGTH = "readme-length"

# The files taggers and scorers test for.
TESTED_FILES = GLOBS | PRESENCE_GLOBS | {"jenkins": "Jenkinsfile", "circle": ".circleci/config.yml"}

# Languages with a size limit of their own.
LIMITED_LANGUAGES = {"yaml": "YAML", "powershell": "PowerShell", "shell": "Shell"}


def _presence_aspect(name: str, glob: str) -> a.Aspect:
    return a.Aspect(FILE, None, glob, lambda path: F.array(item(FILE, name, path)), "path")


PRESENCE_ASPECTS = [_presence_aspect(name, glob) for name, glob in TESTED_FILES.items()]
MANIFEST_ASPECTS = [
    a.Aspect(MANIFEST, None, f"**/{m}", lambda path: F.array(item(MANIFEST, directory_of(path), path)), "path")
    for m in MANIFESTS
]
README_ASPECT = a.Aspect(
    README_LENGTH, None, "README.md", lambda text: F.array(item(README_LENGTH, README_LENGTH, F.length(text)))
)
def has_type(fact_type: str) -> Column:
    return F.coalesce(F.max(F.col("type") == fact_type), F.lit(False))


def has_file(name: str) -> Column:
    return F.coalesce(F.max((F.col("type") == FILE) & (F.col("name") == name)), F.lit(False))


def uses_library_when(predicate) -> Column:
    """Whether any npm fact satisfies ``predicate(lib, version)``."""
    pair = F.from_json("data", "array<string>")
    hit = (F.col("type") == x.NPM) & predicate(F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))
    return F.coalesce(F.max(hit), F.lit(False))


def uses_library(library: str, version: str | None = None) -> Column:
    """Exact library and, when given, exact version, compared on the payload text."""
    data = F.col("data")
    if version:
        hit = data == json.dumps([library, version], separators=(",", ":"), ensure_ascii=False)
    else:
        hit = F.startswith(data, F.lit(f"[{json.dumps(library, ensure_ascii=False)},"))
    return F.coalesce(F.max((F.col("type") == x.NPM) & hit), F.lit(False))


def _lines(language: str | None = None) -> Column:
    measured = F.col("type") == x.METRICS
    if language:
        measured = measured & (F.col("name") == language)
    return F.coalesce(F.sum(F.when(measured, F.col("data").cast("bigint"))), F.lit(0))


def _language_count() -> Column:
    """Distinct languages, as one flag per known language."""
    flags = [
        F.coalesce(F.max((F.col("type") == x.METRICS) & (F.col("name") == lang)), F.lit(False)).cast("int")
        for lang in sorted(set(x.LANGUAGES.values()))
    ]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return total


def fact_columns() -> dict[str, tuple[Column, list[a.Aspect]]]:
    """Column -> (aggregate over the fact items of a repository, aspects it needs)."""
    return {
        "docker": (has_type(x.DOCKER_FROM), [a.DOCKER_FROM]),
        "node": (has_type(x.NPM), [a.NPM]),
        "maven": (has_type(x.MAVEN_DIRECT), [a.MAVEN_DIRECT]),
        "typescript": (has_type(x.TYPESCRIPT), [a.TYPESCRIPT]),
        "tslint": (has_type(x.TSLINT), [a.TSLINT]),
        "clojure": (has_type(x.LEIN), [a.LEIN]),
        "spring_boot": (has_type(x.BOOT_VERSION), [a.BOOT_VERSION]),
        "travis": (has_type(x.TRAVIS), [a.TRAVIS]),
        "python": (has_type(x.PYTHON), [a.PYTHON]),
        "vulnerable": (has_type(x.SECRET), [a.SECRETS]),
        "angular": (uses_library_when(lambda lib, v: F.contains(lib, F.lit("angular"))), [a.NPM]),
        "react": (uses_library("react"), [a.NPM]),
        "chai": (uses_library("chai"), [a.NPM]),
        "mocha": (uses_library("mocha"), [a.NPM]),
        "tslint_dependency": (uses_library("tslint"), [a.NPM]),
        "jenkins": (has_file("jenkins"), PRESENCE_ASPECTS),
        "circle": (has_file("circle"), PRESENCE_ASPECTS),
        "azure": (has_file("azure-pipelines"), PRESENCE_ASPECTS),
        "snyk": (has_file("snyk"), PRESENCE_ASPECTS),
        "csharp": (has_file("csproject"), PRESENCE_ASPECTS),
        "code_of_conduct": (has_file("code-of-conduct"), PRESENCE_ASPECTS),
        "changelog": (has_file("changelog"), PRESENCE_ASPECTS),
        "contributing": (has_file("contributing"), PRESENCE_ASPECTS),
        "license": (has_file("license"), PRESENCE_ASPECTS),
        "readme_length": (F.max(F.when(F.col("type") == README_LENGTH, F.col("data").cast("bigint"))), [README_ASPECT]),
        "projects": (F.count_distinct(F.when(F.col("type") == MANIFEST, F.col("name"))), MANIFEST_ASPECTS),
        "lines": (_lines(), [a.METRICS]),
        "languages": (_language_count(), [a.METRICS]),
    } | {f"lines_{key}": (_lines(language), [a.METRICS]) for key, language in LIMITED_LANGUAGES.items()}


GIT_COLUMNS = ["branches", "days", "committers"]


def repo_profile(
    files: DataFrame | None,
    snapshots: DataFrame,
    pushes: DataFrame,
    as_of: Column,
    columns: list[str] | None = None,
) -> DataFrame:
    """(repo, <columns>) for every analysed repository.

    ``files`` are those of the ``snapshots``; ``columns`` limits the row, and
    with it the aspects that run and the histories that are summed up.
    """
    profile = snapshots.select("repo")
    available = fact_columns()
    columns = [*available, *GIT_COLUMNS] if columns is None else columns
    wanted = {k: v for k, v in available.items() if k in columns}
    if wanted:
        aspects = list({asp.name + asp.glob: asp for _, needed in wanted.values() for asp in needed}.values())
        facts = a.fact_items(files, aspects).groupBy("repo").agg(*[agg.alias(name) for name, (agg, _) in wanted.items()])
        profile = profile.join(facts, "repo", "left").fillna(False).fillna(0)
    if "branches" in columns:
        profile = profile.join(branch_count(pushes), "repo")
    if "days" in columns:
        profile = profile.join(git_recency(pushes, as_of).select("repo", "days"), "repo")
    if "committers" in columns:
        profile = profile.join(active_committers(pushes), "repo")
    return profile
