"""Facts from git history and delivery events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.payload import KEYS, with_envelope
from fleetlens.functions.text import line_count, round6
from fleetlens.operators.sequencing import newest_n, number_rows, trailing_frame

COMMIT_DEPTH = 30


def branch_count(pushes: DataFrame) -> DataFrame:
    """Distinct branches per repo: (repo, branches)."""
    return pushes.groupBy("repo").agg(F.count_distinct("branch").alias("branches"))


def git_recency(pushes: DataFrame, as_of: Column) -> DataFrame:
    """Newest commit per repo and its age in days at ``as_of``."""
    last = pushes.groupBy("repo").agg(F.max("ts").alias("last_ts"))
    return last.select("repo", "last_ts", F.datediff(as_of, "last_ts").cast("bigint").alias("days"))


def active_committers(pushes: DataFrame, depth: int = COMMIT_DEPTH) -> DataFrame:
    """Distinct committers among the newest ``depth`` commits per repo."""
    recent = newest_n(pushes.select("repo", "ts", "push_id", "committer"), "repo", [F.desc("ts"), F.desc("push_id")], depth)
    return recent.groupBy("repo").agg(F.count_distinct("committer").alias("committers"))


def code_metrics(files: DataFrame) -> DataFrame:
    """Files and lines per (repo, language) with per-repo and overall totals.

    ``level``: 0 language, 1 repo, 3 everything.
    """
    lines = files.select("repo", "language", line_count(F.col("content")).alias("lines"))
    return lines.rollup("repo", "language").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count("*").alias("files"),
        F.sum("lines").alias("lines"),
    )


def exact_sum(column: str) -> Column:
    """A sum that does not depend on the order of its input."""
    return F.sum(F.col(column).cast("decimal(18,6)")).cast("double")


def build_time(events: DataFrame) -> DataFrame:
    """Number, mean, median and longest duration of successful builds per repo.

    The median is exact and taken from ranks, so no task holds the durations of
    a whole repository: builds are ranked by duration and the one or two middle
    ranks are averaged.
    """
    builds = events.filter(F.col("kind") == "build").select("event_id", "repo", "value")
    ranked = number_rows(builds, "repo", ["value", "event_id"])
    middle = F.col("seq").isin(F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2"))
    return ranked.groupBy("repo").agg(
        F.count("*").alias("builds"),
        round6(exact_sum("value") / F.count("*")).alias("mean_seconds"),
        round6(F.avg(F.when(middle, F.col("value")))).alias("median_seconds"),
        F.max("value").alias("max_seconds"),
    )


def build_time_moving(events: DataFrame, rows: int = 5) -> DataFrame:
    """Mean duration of the last ``rows`` builds, at every build of a repo."""
    builds = events.filter(F.col("kind") == "build").select("event_id", "repo", "ts", "value")
    numbered = number_rows(builds, "repo", ["ts", "event_id"])
    framed = trailing_frame(numbered, "repo", rows, {"moving_mean": F.avg("value")})
    return framed.select("event_id", "repo", "value", F.round("moving_mean", 6).alias("moving_mean"))


def suggest_tag(pushes: DataFrame, tag: str, reason: str, test: Column) -> DataFrame:
    """A suggestion fact for every push the test holds for."""
    data = F.to_json(F.struct(F.lit(tag).alias("tag"), F.lit(reason).alias("reason")))
    rows = pushes.filter(F.coalesce(test, F.lit(False))).select(
        *KEYS, F.lit("suggest-tag").alias("type"), F.lit("suggestTag").alias("name"), data.alias("data")
    )
    return with_envelope(rows)


def tag_suggestion_feed(diffs: DataFrame, pushes: DataFrame, repos: DataFrame) -> DataFrame:
    """One feed row per push on which a suggestion appeared or changed."""
    changed = diffs.filter((F.col("type") == "suggest-tag") & F.get_json_object("to_data", "$.tag").isNotNull())
    return (
        changed.join(pushes.select("push_id", "branch"), "push_id")
        .join(repos, "repo")
        .select(
            "owner",
            "repo",
            "branch",
            "push_id",
            F.concat_ws("/", F.lit("https:/"), F.lit("git.example.org"), "owner", F.col("repo").cast("string")).alias("url"),
            F.get_json_object("to_data", "$.tag").alias("tag"),
            F.get_json_object("to_data", "$.reason").alias("reason"),
        )
    )


def confirmed_tags(confirmations: DataFrame) -> DataFrame:
    """Human confirmations (repo, push_id, tag, reason) as facts named by the tag."""
    data = F.to_json(F.struct("tag", "reason"))
    return with_envelope(
        confirmations.select(*KEYS, F.lit("confirmed-tag").alias("type"), F.col("tag").alias("name"), data.alias("data"))
    )
