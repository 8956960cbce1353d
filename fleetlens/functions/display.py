"""What a reader sees for a fact: its value and its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.names import k8s_display_name, k8s_name, npm_name_decode

# Fact types whose name is shown as a constant.
CONSTANT_NAMES = {
    "typescript-version": "TypeScript version",
    "spring-boot-version": "Spring Boot version",
    "stack": "Technology stack",
    "javaBuild": "Java build tool",
    "ci": "CI tool",
}


def _field(data: Column, path: str) -> Column:
    return F.get_json_object(data, path)


def _words(data: Column) -> Column:
    return F.array_join(F.from_json(data, "array<string>"), ",")


def without_first(text: Column, part: Column) -> Column:
    """Text with the first occurrence of ``part`` removed."""
    at = F.position(part, text)
    return F.when(at == 0, text).otherwise(
        F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part)))
    )


def display_value(type_: Column, name: Column, data: Column) -> Column:
    """Readable value of a fact by its type; other types show their payload."""
    versions = F.from_json(data, "versions array<struct<version:string>>").getField("versions")
    frameworks = F.from_json(data, "matches array<struct<matchValue:string>>").getField("matches")
    first_framework = F.get(frameworks, F.lit(0)).getField("matchValue")
    k8s = k8s_name(_field(data, "$.kind"), _field(data, "$.metadata.namespace"), _field(data, "$.metadata.name"))
    return (
        F.when(type_ == "npm-project-deps", F.get(F.from_json(data, "array<string>"), F.lit(1)))
        .when(type_.isin("typescript-version", "travis-scripts"), _words(data))
        .when(type_ == "python-direct-dep", without_first(data, name))
        .when(type_.isin("maven-parent-pom", "maven-direct-dep"), _field(data, "$.version"))
        .when(type_ == "spring-boot-starter", F.coalesce(F.nullif(_field(data, "$.version"), F.lit("")), F.lit("inherited")))
        .when(type_ == "maven-deps", F.coalesce(F.nullif(_field(data, "$.version"), F.lit("")), F.lit("no version")))
        .when(type_ == "spring-boot-version", F.array_join(F.transform(versions, lambda v: v["version"]), ","))
        .when(type_ == "csproject-targetframeworks", F.coalesce(first_framework, F.lit("None")))
        .when(type_ == "confirmed-tag", F.concat(_field(data, "$.tag"), F.lit(" because "), _field(data, "$.reason")))
        .when(type_ == "suggest-tag", _field(data, "$.tag"))
        .when(type_ == "k8s-specs", k8s_display_name(k8s))
        .otherwise(data)
    )


def display_name(type_: Column, name: Column) -> Column:
    out = F.when(type_ == "npm-project-deps", npm_name_decode(name)).when(type_ == "k8s-specs", k8s_display_name(name))
    for fact_type, shown in CONSTANT_NAMES.items():
        out = out.when(type_ == fact_type, F.lit(shown))
    return out.otherwise(name)
