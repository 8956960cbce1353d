"""What changed between consecutive pushes of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.names import k8s_display_name
from fleetlens.operators.sequencing import number_rows


def push_links(pushes: DataFrame) -> DataFrame:
    """(repo, push_id, seq, next_push_id): every push with its successor."""
    numbered = number_rows(pushes.select("repo", "push_id", "ts"), "repo", ["ts", "push_id"])
    following = numbered.select(
        F.col("repo").alias("_repo"), (F.col("seq") - 1).alias("_seq"), F.col("push_id").alias("next_push_id")
    )
    return numbered.join(
        following, (F.col("repo") == F.col("_repo")) & (F.col("seq") == F.col("_seq")), "left"
    ).select("repo", "push_id", "seq", "next_push_id")


def fingerprint_diff(facts: DataFrame, pushes: DataFrame) -> DataFrame:
    """(repo, push_id, type, name, change, from_sha, to_sha, from_data, to_data).

    Each fact is sent to its own push as the state after it and to the next
    push as the state before it; one aggregation on (push, type, name) then
    sees both sides. That is a full outer join of the two states with one scan
    and one shuffle of the facts, keyed finely enough that no repository is hot.
    The first push of a repository has nothing to differ from. A snapshot may
    have several facts of one (type, name): the two sets are compared. One fact
    for one other is a change; anything else is told as removals and additions.
    """
    state = F.struct("sha", "data")
    roles = F.array_compact(F.array(
        F.when(F.col("seq") > 1, F.struct(F.col("push_id").alias("at"), F.lit(True).alias("after"))),
        F.when(F.col("next_push_id").isNotNull(), F.struct(F.col("next_push_id").alias("at"), F.lit(False).alias("after"))),
    ))
    spread = (
        facts.select("repo", "push_id", "type", "name", "sha", "data")
        .join(push_links(pushes), ["repo", "push_id"])
        .select("repo", F.explode(roles).alias("r"), "type", "name", state.alias("s"))
    )
    sides = spread.groupBy("repo", F.col("r.at").alias("push_id"), "type", "name").agg(
        F.collect_set(F.when(~F.col("r.after"), F.col("s"))).alias("_old"),
        F.collect_set(F.when(F.col("r.after"), F.col("s"))).alias("_new"),
    )
    gone, come = F.array_except("_old", "_new"), F.array_except("_new", "_old")
    sides = sides.select("repo", "push_id", "type", "name", gone.alias("_gone"), come.alias("_come"))
    none = F.lit(None).cast("struct<sha:string,data:string>")
    swap = F.array(F.struct(F.lit("changed").alias("change"), F.get("_gone", F.lit(0)).alias("before"), F.get("_come", F.lit(0)).alias("after")))
    each = F.concat(
        F.transform("_gone", lambda x: F.struct(F.lit("removed").alias("change"), x.alias("before"), none.alias("after"))),
        F.transform("_come", lambda x: F.struct(F.lit("added").alias("change"), none.alias("before"), x.alias("after"))),
    )
    rows = F.when((F.size("_gone") == 1) & (F.size("_come") == 1), swap).otherwise(each)
    return sides.select("repo", "push_id", "type", "name", F.explode(rows).alias("_c")).select("repo", "push_id", "type", "name", "_c.*").select(
        "repo", "push_id", "type", "name", "change",
        F.col("before.sha").alias("from_sha"), F.col("after.sha").alias("to_sha"),
        F.col("before.data").alias("from_data"), F.col("after.data").alias("to_data"),
    )


def _at(data: str, path: str) -> Column:
    return F.get_json_object(data, path)


def diff_summary(deviations: DataFrame) -> DataFrame:
    """Title and description of a deviation from policy, as plain text.

    Input: owner, repo, branch, type, name, from_data, to_data, target_data.
    """
    where = F.concat_ws("/", "owner", F.col("repo").cast("string"), "branch")
    kind = F.col("type")
    title = (
        F.when(kind == "npm-project-deps", "New NPM Package Policy")
        .when(kind == "npm-project-coordinates", "New Package Coordinate Updated")
        .when(kind == "maven-parent-pom", "New Maven Parent POM Version Policy")
        .when(kind == "k8s-specs", "New Kubernetes Spec Policy")
    )
    description = (
        F.when(
            kind == "npm-project-deps",
            F.concat(
                F.lit("Policy version for NPM package "), _at("from_data", "$[0]"), F.lit(" is "),
                _at("target_data", "$[1]"), F.lit(".\nProject "), where,
                F.lit(" is currently configured to use version "), _at("to_data", "$[1]"), F.lit("."),
            ),
        )
        .when(
            kind == "npm-project-coordinates",
            F.concat(F.lit("from "), F.col("from_data"), F.lit(" to "), F.col("to_data")),
        )
        .when(
            kind == "maven-parent-pom",
            F.concat(
                F.lit("Policy version for Maven dependency "), _at("from_data", "$.group"), F.lit(":"),
                _at("from_data", "$.artifact"), F.lit(" is "), _at("target_data", "$.version"), F.lit(".\nProject "),
                where, F.lit(" is currently using version "), _at("to_data", "$.version"), F.lit("."),
            ),
        )
        .when(
            kind == "k8s-specs",
            F.concat(
                F.lit("Policy version for Kubernetes spec "), k8s_display_name(F.col("name")),
                F.lit(" differs from that in "), where, F.lit("."),
            ),
        )
    )
    return deviations.select("repo", "type", "name", title.alias("title"), description.alias("description"))
