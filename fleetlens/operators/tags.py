"""Tags: yes/no statements about a repository, all decided on one profile row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the tag limits.
MAX_BRANCHES = 20
DEAD_DAYS = 365
HOT_DAYS = 2
HOT_CONTRIBUTORS = 3
MIN_README_LENGTH = 200

# Tag -> condition over the profile row, as a SQL expression. User tags may also
# be Columns.
TYPE_TAGS: dict[str, Column | str] = {
    "docker": "docker",
    "node": "node",
    "maven": "maven",
    "typescript": "typescript",
    "tslint": "tslint",
    "clojure": "clojure",
    "spring-boot": "spring_boot",
    "travis": "travis",
    "python": "python",
}
LIBRARY_TAGS = {"react": "react", "chai": "chai", "mocha": "mocha"}
LIBRARY_WHEN_TAGS = {"angular": "angular"}
CLASS_TAGS = {"jenkins": "jenkins", "circleci": "circle"}
FILE_TAGS = {"azure-pipelines": "azure", "CSharp": "csharp", "snyk": "snyk"}
LINE_TAGS = {
    "huge (>10k)": "lines > 10000",
    "big (3-10k)": "lines BETWEEN 3000 AND 10000",
    "tiny (<200)": "lines < 200",
}
README_TAGS = {"inadequate-readme": f"readme_length < {MIN_README_LENGTH}"}
PRESENCE_TAGS = {
    "code-of-conduct": "code_of_conduct",
    "changelog": "changelog",
    "contributing": "contributing",
    "license": "license",
}
MISC_TAGS = {"vulnerable": "vulnerable", "monorepo": "projects > 1", "sole-committer": "committers = 1"}


def branching_tags(max_branches: int = MAX_BRANCHES) -> dict[str, Column | str]:
    return {"excessive-branches": f"branches > {max_branches}"}


def dead_tags(dead_days: int = DEAD_DAYS) -> dict[str, Column | str]:
    return {"dead": f"days > {dead_days}"}


def hot_tags(hot_days: int = HOT_DAYS, hot_contributors: int = HOT_CONTRIBUTORS) -> dict[str, Column | str]:
    return {"hot": f"days <= {hot_days} AND committers >= {hot_contributors}"}


def taggers(max_branches: int = MAX_BRANCHES, dead_days: int = DEAD_DAYS) -> dict[str, Column | str]:
    """All simple tags. Add your own by merging another dict of conditions."""
    return (
        TYPE_TAGS | LIBRARY_TAGS | LIBRARY_WHEN_TAGS | CLASS_TAGS | FILE_TAGS | LINE_TAGS | README_TAGS
        | PRESENCE_TAGS | MISC_TAGS | branching_tags(max_branches) | dead_tags(dead_days)
    )


def combination_taggers(hot_days: int = HOT_DAYS, hot_contributors: int = HOT_CONTRIBUTORS) -> dict[str, Column | str]:
    return hot_tags(hot_days, hot_contributors)


def tag_repos(profile: DataFrame, tags: dict[str, Column | str]) -> DataFrame:
    """(repo, tag) for every condition that holds."""
    conditions = {tag: F.expr(c) if isinstance(c, str) else c for tag, c in tags.items()}
    present = F.array_compact(F.array(*[F.when(condition, F.lit(tag)) for tag, condition in conditions.items()]))
    return profile.select("repo", F.explode(present).alias("tag"))


def tag_counts(repo_tags: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories per tag and their share of all analysed repositories."""
    total = repos.agg(F.count(F.lit(1))).scalar()
    counts = repo_tags.groupBy("tag").agg(F.count(F.lit(1)).alias("repos"))
    return counts.select("tag", "repos", F.round(F.col("repos") / total, 6).alias("share"))
