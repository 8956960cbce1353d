"""File edits that bring a snapshot back to policy.

Each job joins the deviating facts of a file to the file and folds the edits
over its content. The edits of one file are bounded by the entries of that file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.documents import yaml_text
from fleetlens.operators.extractors import K8S, NPM, PARENT_POM, POM_VALUE, TYPESCRIPT


def _literal(text: Column) -> Column:
    """A pattern that matches exactly this text."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _replacement(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def set_library_version(content: Column, lib: Column, version: Column) -> Column:
    """Rewrite the ``"lib": "..."`` entry of the dependencies and of the devDependencies of a package manifest; text of
    other sections (scripts, say) stays."""
    section = '(?<head>"(?:dependencies|devDependencies)"\\s*:\\s*\\{[^{}]*?)"'
    pattern = F.concat(F.lit(section), _literal(lib), F.lit('"\\s*:\\s*"[^"]*"'))
    entry = F.concat(F.lit('"'), lib, F.lit('": "'), version, F.lit('"'))
    return F.regexp_replace(content, pattern, F.concat(F.lit("${head}"), _replacement(entry)))


def set_parent_version(content: Column, group: Column, artifact: Column, version: Column) -> Column:
    """Rewrite the version of the first parent block with this group and artifact."""
    pattern = F.concat(
        F.lit("(?s)^(?<head>.*?<parent>\\s*<groupId>\\s*"), _literal(group),
        F.lit("\\s*</groupId>\\s*<artifactId>\\s*"), _literal(artifact),
        F.lit(f"\\s*</artifactId>\\s*<version>\\s*){POM_VALUE}(?<tail>\\s*</version>)"),
    )
    return F.regexp_replace(content, pattern, F.concat(F.lit("${head}"), _replacement(version), F.lit("${tail}")))


def _fold(files: DataFrame, edits: DataFrame, keys: list[str], apply) -> DataFrame:
    """Apply all edits of a file in a fixed order; files without edits are left out."""
    fields = [c for c in edits.columns if c not in keys]
    per_file = edits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_edits"))
    return files.join(per_file, keys).select(
        "repo", "push_id", "path",
        F.size("_edits").cast("bigint").alias("edits"),
        F.aggregate("_edits", F.col("content"), apply).alias("content"),
    )


def npm_remediation(files: DataFrame, deviations: DataFrame) -> DataFrame:
    """package.json files with all deviating libraries set to their target version."""
    edits = deviations.filter(F.col("type") == NPM).select(
        "repo",
        "push_id",
        F.get_json_object("target_data", "$[0]").alias("lib"),
        F.get_json_object("target_data", "$[1]").alias("version"),
    )
    manifests = files.filter(F.col("path") == "package.json")
    return _fold(manifests, edits, ["repo", "push_id"], lambda text, e: set_library_version(text, e["lib"], e["version"]))


def parent_pom_remediation(files: DataFrame, deviations: DataFrame) -> DataFrame:
    """POM files with deviating parents set to their target version.

    ``deviations`` carries the ``path`` the parent was found in.
    """
    edits = deviations.filter(F.col("type") == PARENT_POM).select(
        "repo",
        "push_id",
        "path",
        *[F.get_json_object("target_data", f"$.{f}").alias(f) for f in ("group", "artifact", "version")],
    ).distinct()
    return _fold(
        files, edits, ["repo", "push_id", "path"],
        lambda text, e: set_parent_version(text, e["group"], e["artifact"], e["version"]),
    )


def k8s_remediation(specs: DataFrame, targets: DataFrame) -> DataFrame:
    """Resource files replaced by the target of the same name, YAML or JSON by extension.

    ``specs`` is (repo, push_id, path, type, name, ...): the facts with their path.
    """
    joined = specs.filter(F.col("type") == K8S).join(targets, ["type", "name"])
    is_yaml = F.col("path").rlike("\\.ya?ml$")
    return joined.withColumn("_yaml", yaml_text(F.col("target_data"), is_yaml)).select(
        "repo", "push_id", "path", "name", F.when(is_yaml, F.col("_yaml")).otherwise(F.col("target_data")).alias("content")
    )


def typescript_remediation(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Plan rows: where the target is one version, set it as a dev dependency.

    The install itself is a process on the checkout and is not run here.
    """
    versions = F.from_json("target_data", "array<string>")
    deviating = facts.filter(F.col("type") == TYPESCRIPT).join(targets, ["type", "name"])
    return deviating.filter((F.col("sha") != F.col("target_sha")) & (F.size(versions) == 1)).select(
        "repo",
        "push_id",
        F.lit("package.json").alias("path"),
        F.lit("devDependencies").alias("section"),
        F.lit("typescript").alias("lib"),
        F.get(versions, F.lit(0)).alias("version"),
    )
