"""Queries over tags and scores: conditions on one profile row per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.operators import scores as s
from fleetlens.operators import tags as t
from fleetlens.operators.profile import repo_profile
from fleetlens.plans.registry import query
from fleetlens.plans.sql import with_ctes
from fleetlens.sources.driver import Fleet

EVERYTHING = [
    "package.json", "requirements.txt", "project.clj", "pom.xml", "module/pom.xml", "App.csproj", "tslint.json",
    "Dockerfile", ".travis.yml", "README.md", "priority", "config.env", "src",
]


def profile(fleet: Fleet, columns: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Profile of the newest snapshots; ``kinds`` names the files the columns need."""
    latest = fleet.latest_pushes()
    kinds = EVERYTHING if columns is None else kinds
    files = fleet.files(kinds, latest) if kinds else None
    return repo_profile(files, latest, fleet.pushes(), fleet.as_of(), columns)


# --- tags -----------------------------------------------------------------

_has = lambda kind: f"list_contains(has, '{kind}')"
_lib = lambda lib: f"list_contains(libs, '{lib}')"

TAG_SQL = {
    "docker": _has("LARGE"),
    "node": "len(libs) > 0",
    "maven": _has("PROMO"),
    "typescript": _lib("typescript"),
    "tslint": _has("ECONOMY"),
    "clojure": _has("SMALL") + " AND p = '3-MEDIUM'",
    "spring-boot": "promo_top % 2 = 0",
    "travis": _has("MEDIUM"),
    "python": _has("SMALL"),
    "react": _lib("react"),
    "chai": _lib("chai"),
    "mocha": _lib("mocha"),
    "angular": _lib("@angular/core"),
    "jenkins": "p = '3-MEDIUM'",
    "circleci": "p = '2-HIGH'",
    "azure-pipelines": "p = '5-LOW'",
    "CSharp": _has("ECONOMY"),
    "snyk": "p = '4-NOT SPECIFIED'",
    "huge (>10k)": "lines > 10000",
    "big (3-10k)": "lines BETWEEN 3000 AND 10000",
    "tiny (<200)": "lines < 200",
    "inadequate-readme": "readme < 200",
    "code-of-conduct": "p = '4-NOT SPECIFIED'",
    "changelog": "p = '3-MEDIUM'",
    "contributing": "p = '4-NOT SPECIFIED'",
    "license": "p IN ('1-URGENT', '2-HIGH')",
    "vulnerable": "p = '5-LOW'",
    "monorepo": _has("PROMO"),
    "sole-committer": "committers = 1",
    "excessive-branches": "branches > 20",
    "dead": "days > 365",
    "hot": "days <= 2 AND committers >= 3",
}
assert set(TAG_SQL) == set(t.taggers() | t.combination_taggers())


def _tag_sql(tags: list[str], conditions: dict[str, str] = TAG_SQL) -> str:
    cases = ", ".join(f"CASE WHEN {conditions[tag]} THEN '{tag}' END" for tag in tags)
    return with_ctes(f"SELECT repo, tag FROM (SELECT repo, unnest([{cases}]) AS tag FROM prof) WHERE tag IS NOT NULL", "prof")


def _tags(key: str, tags: dict, columns: list[str], kinds: list[str], conditions: dict[str, str] = TAG_SQL) -> None:
    @query(key, _tag_sql(list(tags), conditions))
    def job(fleet: Fleet) -> DataFrame:
        return t.tag_repos(profile(fleet, columns, kinds), tags)


def all_tags() -> dict:
    return t.taggers() | t.combination_taggers()


@query("repo_tags", _tag_sql(list(TAG_SQL)))
def _repo_tags(fleet: Fleet) -> DataFrame:
    return t.tag_repos(profile(fleet), all_tags())


_tags(
    "tags_by_type", t.TYPE_TAGS, list(t.TYPE_TAGS.values()),
    ["package.json", "requirements.txt", "project.clj", "pom.xml", "tslint.json", "Dockerfile", ".travis.yml"],
)
_tags("tags_uses_library", t.LIBRARY_TAGS, ["react", "chai", "mocha"], ["package.json"])
_tags("tags_library_when", t.LIBRARY_WHEN_TAGS, ["angular"], ["package.json"])
_tags("tags_by_class", t.CLASS_TAGS, ["jenkins", "circle"], ["priority"])
_tags("tags_by_file_match", t.FILE_TAGS, ["azure", "csharp", "snyk"], ["App.csproj", "priority"])
_tags("tags_line_count", t.LINE_TAGS, ["lines"], ["src"])
# repositories of the given fleet have at most three branches: the limit is set where it tells them apart
_tags("tags_branching", t.branching_tags(2), ["branches"], [], {"excessive-branches": "branches > 2"})
_tags("tags_dead", t.dead_tags(), ["days"], [])
_tags("tags_hot", t.hot_tags(), ["days", "committers"], [])
_tags("tags_readme", t.README_TAGS, ["readme_length"], ["README.md"])
_tags(
    "tags_presence", t.PRESENCE_TAGS, ["code_of_conduct", "changelog", "contributing", "license"], ["priority"]
)
_tags(
    "tags_misc", t.MISC_TAGS, ["vulnerable", "projects", "committers"],
    ["package.json", "pom.xml", "module/pom.xml", "config.env"],
)


@query(
    "tag_counts",
    f"SELECT tag, count(*) AS repos, round(count(*) / (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'), 6) AS share "
    f"FROM ({_tag_sql(list(TAG_SQL))}) GROUP BY tag",
)
def _tag_counts(fleet: Fleet) -> DataFrame:
    analysed = fleet.pushes().filter("is_default").select("repo").distinct()
    return t.tag_counts(t.tag_repos(profile(fleet), all_tags()), analysed)


# --- scores ------------------------------------------------------------------


def _clamp(x: str) -> str:
    return f"least(5.0, greatest(1.0, ({x})::DOUBLE))"


def _required(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 5.0 ELSE 1.0 END"


SCORE_SQL = {
    "anchor": ("2.0", "'Starting score'"),
    "excessive-branches": (_clamp("5 - greatest(0, branches - 5) / 5"), "branches || ' branches'"),
    "monorepo": (
        f"CASE WHEN {_has('PROMO')} THEN 2.0 END",
        f"CASE WHEN {_has('PROMO')} THEN '2 projects in one repository' END",
    ),
    "has-tslint": (
        f"CASE WHEN {_lib('typescript')} THEN {_required(_lib('tslint'))} END",
        f"CASE WHEN NOT {_lib('typescript')} THEN NULL WHEN {_lib('tslint')} THEN 'TypeScript project using tslint' "
        "ELSE 'TypeScript projects should use tslint' END",
    ),
    "license": (_required("p IN ('1-URGENT', '2-HIGH')"), "'Repositories should have a license'"),
    "languages": (_clamp("5 - greatest(0, languages - 4)"), "languages || ' languages'"),
    "lines-of-code": (_clamp("5 - lines / 30000"), "lines || ' lines'"),
    "lines-of-yaml": (_clamp("5 - greatest(0, yaml - 200) / 500"), "yaml || ' lines of yaml'"),
    "lines-of-powershell": (_clamp("5 - greatest(0, powershell - 100) / 200"), "powershell || ' lines of powershell'"),
    "lines-of-shell": (_clamp("5 - greatest(0, shell - 100) / 200"), "shell || ' lines of shell'"),
    "recent-commit": (_clamp("5 - days / 30"), "days || ' days since the last commit'"),
    "code-of-conduct": (_required("p = '4-NOT SPECIFIED'"), "'Repos should have a code of conduct'"),
    "changelog": (_required("p = '3-MEDIUM'"), "'CHANGELOG.md required'"),
    "contributing": (_required("p = '4-NOT SPECIFIED'"), "'CONTRIBUTING.md required'"),
}


def _score_sql(names: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT repo, '{n}' AS scorer, round(({SCORE_SQL[n][0]})::DOUBLE, 6) AS score, {SCORE_SQL[n][1]} AS reason FROM prof"
        for n in names
    )
    return with_ctes(rows, "prof")


def _scores(key: str, names: list[str], columns: list[str], kinds: list[str]) -> None:
    @query(key, _score_sql(names))
    def job(fleet: Fleet) -> DataFrame:
        scorers = s.scorers()
        return s.score_repos(profile(fleet, columns, kinds), {n: scorers[n] for n in names})


_scores("score_anchor", ["anchor"], [], [])
_scores("score_branches", ["excessive-branches"], ["branches"], [])
_scores("score_monorepo", ["monorepo"], ["projects"], ["package.json", "pom.xml", "module/pom.xml"])
_scores("score_tslint", ["has-tslint"], ["typescript", "tslint_dependency"], ["package.json"])
_scores("score_license", ["license"], ["license"], ["priority"])
_scores("score_languages", ["languages"], ["languages"], ["src"])
_scores("score_loc", ["lines-of-code"], ["lines"], ["src"])
_scores(
    "score_loc_in", ["lines-of-yaml", "lines-of-powershell", "lines-of-shell"],
    ["lines_yaml", "lines_powershell", "lines_shell"], ["src"],
)
_scores("score_recent_commit", ["recent-commit"], ["days"], [])
_scores("score_require_aspect", ["code-of-conduct"], ["code_of_conduct"], ["priority"])
_scores("score_require_glob", ["changelog", "contributing"], ["changelog", "contributing"], ["priority"])


@query("repo_scores", _score_sql(list(SCORE_SQL)))
def _repo_scores(fleet: Fleet) -> DataFrame:
    return s.score_repos(profile(fleet), s.scorers())


@query(
    "repo_total_score",
    f"""SELECT repo, total_score, rank() OVER (ORDER BY total_score DESC) AS rank FROM (
    SELECT repo, floor((2 * sum(round(score * 1000000)::BIGINT) + count(score)) / (2 * count(score))) / 1000000 AS total_score
    FROM ({_score_sql(list(SCORE_SQL))}) GROUP BY repo)""",
)
def _repo_total_score(fleet: Fleet) -> DataFrame:
    return s.total_scores(s.score_repos(profile(fleet), s.scorers()))


FILE_CHANGE = _clamp("1 + coalesce(len(files_changed), 0) / 2")
POM_CHANGED = "(CASE WHEN coalesce(list_contains(files_changed, 'pom.xml'), false) THEN 5.0 ELSE 1.0 END)::DOUBLE"


@query("push_file_change_score", with_ctes(f"SELECT repo, push_id, {FILE_CHANGE} AS score FROM pf", "pf"))
def _push_file_change_score(fleet: Fleet) -> DataFrame:
    return fleet.pushes_with_files().select("repo", "push_id", s.file_change_score().alias("score"))


@query("push_pom_score", with_ctes(f"SELECT repo, push_id, {POM_CHANGED} AS score FROM pf", "pf"))
def _push_pom_score(fleet: Fleet) -> DataFrame:
    return fleet.pushes_with_files().select("repo", "push_id", s.pom_changed_score().alias("score"))


COMMIT_RISK_SQL = f"""SELECT repo, push_id, file_change, pom_changed, round((file_change + pom_changed) / 2, 6) AS risk
    FROM (SELECT repo, push_id, {FILE_CHANGE} AS file_change, {POM_CHANGED} AS pom_changed FROM pf)"""


@query("push_commit_risk", with_ctes(COMMIT_RISK_SQL, "pf"))
def _push_commit_risk(fleet: Fleet) -> DataFrame:
    return s.commit_risk(fleet.pushes_with_files())
