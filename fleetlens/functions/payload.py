"""The fact item and its envelope.

A *fact* says that one snapshot of a repository has ``(type, name, data)``.
``data`` is the normalised payload text and ``sha`` is the SHA-256 of exactly
that text, so two facts are the same variant iff (type, name, sha) are equal.
Extractors return arrays of the three-field item; the constant and derived
fields are added after ``explode``, in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM_TYPE = "struct<type:string,name:string,data:string>"
ENVELOPE = ["type", "name", "abbreviation", "version", "data", "sha"]
KEYS = ["repo", "push_id"]

# Abbreviation and format version per fact type.
ABBREVIATIONS = {
    "npm-project-deps": "npmdeps",
    "npm-project-coordinates": "npm-project-coordinates",
    "typescript-version": "tsv",
    "python-direct-dep": "pydep",
    "maven-parent-pom": "mvnp",
    "maven-direct-dep": "mvn",
    "maven-deps": "mvn",
    "k8s-specs": "k8sspecs",
}
VERSIONS = {
    "npm-project-deps": "0.0.1",
    "npm-project-coordinates": "0.0.1",
    "typescript-version": "0.1.0",
    "python-direct-dep": "0.1.0",
    "maven-parent-pom": "0.1.0",
    "maven-direct-dep": "0.1.0",
    "maven-deps": "0.1.0",
    "k8s-specs": "0.0.1",
}


def item(type_: str | Column, name: Column | str, data: Column) -> Column:
    """One extracted fact, before it gets its envelope."""
    return F.struct(
        (F.lit(type_) if isinstance(type_, str) else type_).alias("type"),
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        data.cast("string").alias("data"),
    ).cast(ITEM_TYPE)


def no_items() -> Column:
    return F.array().cast(f"array<{ITEM_TYPE}>")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A small constant map as a CASE expression; absent keys give null."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def sha_of(data: Column) -> Column:
    return F.sha2(data, 256)


def with_envelope(df: DataFrame, keep: list[str] = KEYS) -> DataFrame:
    """(keys, type, name, data) -> full fact rows."""
    return df.select(
        *keep,
        "type",
        "name",
        lookup(F.col("type"), ABBREVIATIONS).alias("abbreviation"),
        lookup(F.col("type"), VERSIONS).alias("version"),
        "data",
        sha_of(F.col("data")).alias("sha"),
    )


def json_text(value: Column) -> Column:
    """A string as a JSON string literal."""
    quoted = F.to_json(F.array(value))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def canonical_json(text: Column) -> Column:
    """Compact JSON with recursively sorted keys; null when not JSON."""
    return F.to_json(F.try_parse_json(text))


def canonical_sha(text: Column) -> Column:
    """Hash that does not depend on key order or white space of the JSON."""
    return sha_of(canonical_json(text))
