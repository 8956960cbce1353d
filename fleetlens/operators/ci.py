"""The full record of a CI file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.documents import string_list, truthy, yaml_or_json
from fleetlens.functions.payload import KEYS, canonical_json, sha_of


def travis_profile(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """language, scripts, services, branch rules, lifecycle lists and addons.

    ``only`` and ``except`` are null when the file has no branch rules.
    """
    rows = files.filter(F.col("path") == ".travis.yml")
    document = yaml_or_json(F.col("content"))
    parsed = rows.withColumn("_v", F.try_parse_json(document)).filter(F.col("_v").isNotNull())

    def node(path: str):
        return F.try_variant_get("_v", f"$.{path}", "variant")

    has_branches = truthy(node("branches"))
    return parsed.select(
        *keys,
        F.try_variant_get("_v", "$.language", "string").alias("language"),
        string_list(node("script")).alias("scripts"),
        F.array_distinct(string_list(node("services"))).alias("services"),
        F.when(has_branches, string_list(node("branches.only"))).alias("only"),
        F.when(has_branches, string_list(node("branches.except"))).alias("except"),
        string_list(node("before_install")).alias("before_install"),
        string_list(node("after_success")).alias("after_success"),
        string_list(node("node_js")).alias("node_js"),
        F.to_json(node("addons")).alias("addons"),
    )


def document_shas(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Canonical JSON and its hash of YAML or JSON files; unreadable files give null."""
    document = yaml_or_json(F.col("content"))
    canonical = files.withColumn("_d", document).withColumn("document", canonical_json(F.col("_d")))
    return canonical.select(*keys, "path", "document", sha_of(F.col("document")).alias("sha"))
