"""Scores on a 1..5 scale; null means no opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import clamp
from fleetlens.session import cut_lineage

# Parameters of the repository scorers.
ANCHOR = 2.0
BRANCH_LIMIT = 5
LANGUAGE_LIMIT = 4
LINE_LIMIT = 30000
LANGUAGE_LINE_LIMITS = {"yaml": (500, 200), "powershell": (200, 100), "shell": (200, 100)}
RECENT_DAYS = 30


def _c(name: str) -> Column:
    return F.col(name)


def _required(flag: str) -> Column:
    return F.when(_c(flag), F.lit(5.0)).otherwise(F.lit(1.0))


def _over(count: Column, limit: int) -> Column:
    return F.greatest(F.lit(0), count - limit)


def _lines_in(key: str) -> tuple[Column, Column]:
    limit, free = LANGUAGE_LINE_LIMITS[key]
    lines = _c(f"lines_{key}")
    score = clamp(5 - F.greatest(F.lit(0), lines - free) / limit)
    return score, F.concat(lines.cast("string"), F.lit(f" lines of {key}"))


def scorers() -> dict[str, tuple[Column, Column]]:
    """Scorer name -> (score, reason) over a profile row. Merge a dict to add your own."""
    tslint = F.when(_c("typescript"), _required("tslint_dependency"))
    tslint_reason = F.when(
        _c("typescript"),
        F.when(_c("tslint_dependency"), "TypeScript project using tslint").otherwise("TypeScript projects should use tslint"),
    )
    out = {
        "anchor": (F.lit(ANCHOR), F.lit("Starting score")),
        "excessive-branches": (
            clamp(5 - _over(_c("branches"), BRANCH_LIMIT) / BRANCH_LIMIT),
            F.concat(_c("branches").cast("string"), F.lit(" branches")),
        ),
        "monorepo": (
            F.when(_c("projects") > 1, F.lit(2.0)),
            F.when(_c("projects") > 1, F.concat(_c("projects").cast("string"), F.lit(" projects in one repository"))),
        ),
        "has-tslint": (tslint, tslint_reason),
        "license": (_required("license"), F.lit("Repositories should have a license")),
        "languages": (
            clamp(5 - _over(_c("languages"), LANGUAGE_LIMIT)),
            F.concat(_c("languages").cast("string"), F.lit(" languages")),
        ),
        "lines-of-code": (clamp(5 - _c("lines") / LINE_LIMIT), F.concat(_c("lines").cast("string"), F.lit(" lines"))),
    }
    for key in LANGUAGE_LINE_LIMITS:
        out[f"lines-of-{key}"] = _lines_in(key)
    out["recent-commit"] = (
        clamp(5 - _c("days") / RECENT_DAYS),
        F.concat(_c("days").cast("string"), F.lit(" days since the last commit")),
    )
    out["code-of-conduct"] = (_required("code_of_conduct"), F.lit("Repos should have a code of conduct"))
    out["changelog"] = (_required("changelog"), F.lit("CHANGELOG.md required"))
    out["contributing"] = (_required("contributing"), F.lit("CONTRIBUTING.md required"))
    return out


def score_repos(profile: DataFrame, wanted: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(repo, scorer, score, reason), scores without opinion included as null."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("scorer"), F.round(score.cast("double"), 6).alias("score"), reason.alias("reason"))
        for name, (score, reason) in wanted.items()
    ])
    return profile.select("repo", F.explode(rows).alias("s")).select("repo", "s.*")


def total_scores(repo_scores: DataFrame) -> DataFrame:
    """Mean of the given scores per repo (six decimals), and its rank in the fleet.

    The rank counts repositories with a higher mean. Means are counted by value;
    values of one thousandth form a band, so a window holds a thousand values or
    the four thousand bands between 1 and 5, however many repositories there are.
    """
    millionths = F.sum(F.round(F.col("score") * 1000000).cast("bigint"))
    rounded = F.floor((2 * millionths + F.count("score")) / (2 * F.count("score")))
    means = cut_lineage(repo_scores.groupBy("repo").agg((rounded / 1000000).alias("total_score")), "means")
    sizes = means.groupBy("total_score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_band", F.floor(F.col("total_score") * 1000))

    def before(*keys):
        return F.coalesce(F.sum("_n").over(Window.partitionBy(*keys[:-1]).orderBy(F.desc(keys[-1])).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    bands = sizes.groupBy("_band").agg(F.sum("_n").alias("_n")).select("_band", before("_band").alias("_above"))
    ranks = sizes.select("total_score", "_band", before("_band", "total_score").alias("_within")).join(bands, "_band")
    ranks = ranks.select("total_score", (F.col("_above") + F.col("_within") + 1).alias("rank"))
    return means.join(ranks, "total_score").select("repo", "total_score", "rank")


def file_change_score(limit: int = 2) -> Column:
    """More changed files, more risk: one point per ``limit`` files above 1."""
    changed = F.when(_c("files_changed").isNull(), F.lit(0)).otherwise(F.size("files_changed"))
    return clamp(1 + changed / limit)


def pom_changed_score() -> Column:
    hit = F.coalesce(F.array_contains("files_changed", "pom.xml"), F.lit(False))
    return F.when(hit, F.lit(5.0)).otherwise(F.lit(1.0))


def commit_risk(pushes: DataFrame) -> DataFrame:
    """Both push scores and their mean."""
    scored = pushes.select(
        "repo", "push_id", file_change_score().alias("file_change"), pom_changed_score().alias("pom_changed")
    )
    return scored.withColumn("risk", F.round((F.col("file_change") + F.col("pom_changed")) / 2, 6))
