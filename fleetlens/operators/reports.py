"""Fleet reports over the current facts: (repo, owner, type, name, sha, value).

Counts of repositories are built in two steps: (type, name, ..., repo) first,
which Spark combines map-side, then the group. A library used by a third of
the fleet therefore never meets in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(facts: DataFrame) -> DataFrame:
    """Repositories that use each (type, name)."""
    return facts.groupBy("type", "name").agg(F.count_distinct("repo").alias("repos"))


def variants(facts: DataFrame) -> DataFrame:
    """Repositories per variant of each (type, name)."""
    return facts.groupBy("type", "name", "sha").agg(F.count_distinct("repo").alias("repos"), F.min("value").alias("value"))


def drift(facts: DataFrame) -> DataFrame:
    """Variants, entropy of their shares and the most common variant per (type, name).

    With n repositories per variant and N in all, the entropy is
    ln N - sum(n ln n) / N, so no share has to be joined back.
    """
    n = F.col("repos")
    per_variant = variants(facts)
    total = F.sum(n)
    entropy = F.log(total) - F.sum(n * F.log(n)) / total
    return per_variant.groupBy("type", "name").agg(
        F.count("*").alias("variants"),
        total.alias("repos"),
        F.round(F.abs(entropy), 6).alias("entropy"),
        F.min_by("value", F.struct(-n, F.col("value"))).alias("most_common"),
        F.max(n).alias("most_common_repos"),
    )


def top_drifting(drifts: DataFrame, k: int = 20) -> DataFrame:
    """The k names with most entropy: a bounded sort per task, never a full one."""
    return drifts.orderBy(F.desc("entropy"), F.desc("variants"), "type", "name").limit(k)


def sunburst_tree(facts: DataFrame) -> DataFrame:
    """Sizes of every node of root > type > name > variant > owner.

    ``level`` is the depth of the node. One aggregation to leaves first, then
    the rollup over the leaves only.
    """
    leaves = facts.groupBy("type", "name", "value", "owner").agg(F.count("*").alias("n"))
    depth = F.when(F.grouping("type") == 1, 0).when(F.grouping("name") == 1, 1).when(F.grouping("value") == 1, 2)
    level = depth.when(F.grouping("owner") == 1, 3).otherwise(4)
    return leaves.rollup("type", "name", "value", "owner").agg(level.cast("bigint").alias("level"), F.sum("n").alias("size"))


def owner_comparison(facts: DataFrame) -> DataFrame:
    """Uses and variants per owner and name, with totals over each and over both.

    ``level``: 0 both given, 1 owner only, 2 name only, 3 neither. The cube runs
    over pre-counted (owner, name, variant) rows.
    """
    leaves = facts.groupBy("owner", "name", "sha").agg(F.count("*").alias("n"))
    return leaves.cube("owner", "name").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("n").alias("uses"),
        F.count_distinct("sha").alias("variants"),
    )


def shared_dependencies(facts: DataFrame, owner_a: str, owner_b: str) -> DataFrame:
    """Libraries two owners have in common or only one has; one aggregation."""
    both = facts.filter(F.col("owner").isin(owner_a, owner_b))
    flags = both.groupBy("type", "name").agg(
        F.max(F.col("owner") == owner_a).alias("a"), F.max(F.col("owner") == owner_b).alias("b")
    )
    side = F.when(F.col("a") & F.col("b"), "common").when(F.col("a"), "only-first").otherwise("only-second")
    return flags.select("type", "name", side.alias("side"))


def usage_over_time(facts: DataFrame) -> DataFrame:
    """Share of every variant of a name per month; ``facts`` carries ``ts``."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    counts = facts.groupBy(month, "type", "name", "value").agg(F.count("*").alias("uses"))
    totals = counts.groupBy("month", "type", "name").agg(F.sum("uses").alias("_total"))
    joined = counts.join(totals, ["month", "type", "name"])
    return joined.select("month", "type", "name", "value", "uses", F.round(F.col("uses") / F.col("_total"), 6).alias("share"))


def adoption_over_time(facts: DataFrame, pushes: DataFrame, until: Column | None = None) -> DataFrame:
    """Repositories per variant at the end of every month, also of those without a push in it: (month, type, name, value,
    repos, share).

    ``facts`` is (push_id, type, name, value) and ``pushes`` (repo, push_id, ts). A repository keeps the variants of its last
    push until a later month has one. It adds one when it takes a variant up and takes one off when it has left it, so
    only changes are counted; levels are running sums over the months of a variant. Months run from the first one with a
    push to that of ``until`` (by default the last one with a push).
    """
    month = F.year("ts") * 12 + F.month("ts") - 1
    last = pushes.withColumn("_m", month).groupBy("repo", "_m").agg(F.max_by("push_id", F.struct("ts", "push_id")).alias("push_id"))
    following = F.lead("_m").over(Window.partitionBy("repo").orderBy("_m"))  # at most one row a month
    held = facts.select("push_id", "type", "name", "value").distinct().join(last.withColumn("_n", following), "push_id")
    change = F.explode(F.array(F.struct(F.col("_m").alias("m"), F.lit(1).alias("d")), F.struct(F.col("_n").alias("m"), F.lit(-1).alias("d"))))
    key = ["type", "name", "value"]
    changes = held.select(*key, change.alias("c")).filter("c.m IS NOT NULL").groupBy(*key, F.col("c.m").alias("m")).agg(F.sum("c.d").alias("d")).filter("d != 0")
    along = Window.partitionBy(*key).orderBy("m")
    end = pushes.agg(F.max(month if until is None else F.greatest(month, F.year(until) * 12 + F.month(until) - 1))).first()[0]  # one number
    levels = changes.select(*key, "m", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("repos"), F.lead("m").over(along).alias("_next"))
    months = F.explode(F.sequence(F.col("m"), F.coalesce(F.col("_next") - 1, F.lit(end).cast("int"))))
    stated = levels.filter("repos > 0").select(*key, "repos", months.alias("m"))
    totals = stated.groupBy("m", "type", "name").agg(F.sum("repos").alias("_total"))
    shown = F.format_string("%04d-%02d", F.floor(F.col("m") / 12), F.col("m") % 12 + 1).alias("month")
    return stated.join(totals, ["m", "type", "name"]).select(shown, *key, "repos", F.round(F.col("repos") / F.col("_total"), 6).alias("share"))


def repo_overview(facts: DataFrame, repo_tags: DataFrame, repo_scores: DataFrame) -> DataFrame:
    """All facts, tags and scores as one long table (repo, kind, name, value)."""
    return (
        facts.select("repo", F.concat(F.lit("fact:"), F.col("type")).alias("kind"), "name", "value")
        .unionByName(repo_tags.select("repo", F.lit("tag").alias("kind"), F.col("tag").alias("name"), F.lit(None).cast("string").alias("value")))
        .unionByName(
            repo_scores.select("repo", F.lit("score").alias("kind"), F.col("scorer").alias("name"), F.format_number("score", 3).alias("value"))
        )
    )
