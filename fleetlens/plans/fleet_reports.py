"""Fleet report queries over the current library facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.display import display_value
from fleetlens.operators import aspects as a
from fleetlens.operators import reports as r
from fleetlens.operators import scores as s
from fleetlens.operators import sketches
from fleetlens.operators import tags as t
from fleetlens.operators.aspects import fact_items
from fleetlens.plans.judgement import SCORE_SQL, TAG_SQL, _score_sql, _tag_sql, all_tags, profile
from fleetlens.plans.registry import query
from fleetlens.plans.sources import STORED_BEFORE, default_pushes, npm_facts, with_push_time
from fleetlens.plans.sql import with_ctes
from fleetlens.session import scratch_path
from fleetlens.sources.driver import Fleet


def _with_value(facts: DataFrame) -> DataFrame:
    return facts.withColumn("value", display_value(F.col("type"), F.col("name"), F.col("data")))


def current(fleet: Fleet) -> DataFrame:
    """Current library facts with their shown value."""
    return _with_value(npm_facts(fleet, fleet.latest_pushes()))


def current_with_owner(fleet: Fleet) -> DataFrame:
    return current(fleet).join(fleet.repos().select("repo", "owner"), "repo")


@query("usage", with_ctes("SELECT type, name, count(DISTINCT repo) AS repos FROM depl GROUP BY type, name", "depl"))
def _usage(fleet: Fleet) -> DataFrame:
    return r.usage(current(fleet))


_VARIANTS = "SELECT type, name, sha, count(DISTINCT repo) AS repos, min(version) AS value FROM depl GROUP BY type, name, sha"


@query("variants", with_ctes(_VARIANTS, "depl"))
def _variants(fleet: Fleet) -> DataFrame:
    return r.variants(current(fleet))


_DRIFT = """SELECT type, name, count(*) AS variants, sum(repos)::BIGINT AS repos,
    round(abs(-sum(repos / total * ln(repos / total))), 6) AS entropy, arg_min(value, (-repos, value)) AS most_common,
    max(repos) AS most_common_repos FROM (SELECT *, sum(repos) OVER (PARTITION BY type, name) AS total FROM v) GROUP BY type, name"""


@query("drift", with_ctes(_DRIFT, "depl", extra={"v": _VARIANTS}))
def _drift(fleet: Fleet) -> DataFrame:
    return r.drift(current(fleet))


@query(
    "top_drifting",
    with_ctes(f"SELECT * FROM ({_DRIFT}) ORDER BY entropy DESC, variants DESC, type, name LIMIT 20", "depl", extra={"v": _VARIANTS}),
)
def _top_drifting(fleet: Fleet) -> DataFrame:
    return r.top_drifting(r.drift(current(fleet)), 20)


@query(
    "sunburst_tree",
    with_ctes(
        """SELECT type, name, version AS value, owner, (4 - grouping(type) - grouping(name) - grouping(version) - grouping(owner))::BIGINT
        AS level, count(*) AS size FROM depl JOIN repos USING (repo) GROUP BY ROLLUP (type, name, version, owner)""",
        "depl", "repos",
    ),
)
def _sunburst_tree(fleet: Fleet) -> DataFrame:
    return r.sunburst_tree(current_with_owner(fleet))


@query(
    "owner_comparison",
    with_ctes(
        """SELECT owner, name, grouping(owner, name)::BIGINT AS level, count(*) AS uses, count(DISTINCT sha) AS variants
        FROM depl JOIN repos USING (repo) GROUP BY CUBE (owner, name)""",
        "depl", "repos",
    ),
)
def _owner_comparison(fleet: Fleet) -> DataFrame:
    return r.owner_comparison(current_with_owner(fleet))


@query(
    "shared_deps",
    with_ctes(
        """SELECT type, name, CASE WHEN a AND b THEN 'common' WHEN a THEN 'only-first' ELSE 'only-second' END AS side FROM (
        SELECT type, name, bool_or(owner = 'NATION_1') AS a, bool_or(owner = 'NATION_2') AS b FROM depl JOIN repos USING (repo)
        WHERE owner IN ('NATION_1', 'NATION_2') GROUP BY type, name)""",
        "depl", "repos",
    ),
)
def _shared_deps(fleet: Fleet) -> DataFrame:
    return r.shared_dependencies(current_with_owner(fleet), "NATION_1", "NATION_2")


@query(
    "repo_profile",
    with_ctes(
        f"""SELECT repo, 'fact:npm-project-deps' AS kind, name, version AS value FROM depl UNION ALL
        SELECT repo, 'fact:python-direct-dep', name, substr(data, length(name) + 1) FROM py JOIN latest USING (push_id) UNION ALL
        SELECT repo, 'tag', tag, NULL FROM ({_tag_sql(list(TAG_SQL))}) UNION ALL
        SELECT repo, 'score', scorer, printf('%.3f', score) FROM ({_score_sql(list(SCORE_SQL))})""",
        "depl", "py", "latest",
    ),
)
def _repo_profile(fleet: Fleet) -> DataFrame:
    row = profile(fleet)
    files = fleet.files(["package.json", "requirements.txt"], fleet.latest_pushes())
    facts = _with_value(fact_items(files, [a.NPM, a.PYTHON]))
    return r.repo_overview(facts, t.tag_repos(row, all_tags()), s.score_repos(row, s.scorers()))


@query(
    "usage_over_time",
    with_ctes(
        """SELECT month, type, name, value, uses, round(uses / sum(uses) OVER (PARTITION BY month, type, name), 6) AS share FROM (
        SELECT strftime(ts, '%Y-%m') AS month, type, name, version AS value, count(*) AS uses FROM dep JOIN pushes USING (push_id)
        WHERE is_default GROUP BY ALL)""",
        "dep", "pushes",
    ),
)
def _usage_over_time(fleet: Fleet) -> DataFrame:
    return r.usage_over_time(with_push_time(_with_value(npm_facts(fleet, default_pushes(fleet))), fleet))


@query(
    "adoption_over_time",
    with_ctes(
        """SELECT printf('%04d-%02d', m // 12, m % 12 + 1) AS month, type, name, version AS value, count(*) AS repos,
        round(count(*) / sum(count(*)) OVER (PARTITION BY m, type, name), 6) AS share FROM state JOIN dep USING (push_id) GROUP BY m, type, name, version""",
        "dep", "pushes",
        extra={
            "dated": "SELECT repo, push_id, ts, year(ts) * 12 + month(ts) - 1 AS pm FROM pushes WHERE is_default",
            "months": "SELECT unnest(range((SELECT min(pm) FROM dated), (SELECT max(pm) FROM dated) + 1)) AS m",
            "state": "SELECT repo, m, arg_max(push_id, (ts, push_id)) AS push_id FROM months JOIN dated ON pm <= m GROUP BY repo, m",
        },
    ),
)
def _adoption_over_time(fleet: Fleet) -> DataFrame:
    pushes = default_pushes(fleet)
    return r.adoption_over_time(_with_value(npm_facts(fleet, pushes)), pushes)


def _variant_store(fleet: Fleet) -> DataFrame:
    """The sketches of the fleet, stored; the pushes of two periods are appended one after the other."""
    location = scratch_path(fleet.spark, "variant-sketches")
    pushes = default_pushes(fleet)
    early = F.col("ts") < F.lit(STORED_BEFORE).cast("timestamp_ntz")
    for scope in (pushes.filter(early), pushes.filter(~early)):
        facts = with_push_time(npm_facts(fleet, scope), fleet).join(fleet.repos().select("repo", "owner"), "repo")
        sketches.append(sketches.variant_sketches(facts), location)
    return sketches.stored(fleet.spark, location)


@query(
    "approx_variants",
    with_ctes(
        """SELECT type, name, count(*) AS uses, count(DISTINCT sha) AS variants
        FROM dep JOIN pushes USING (push_id) WHERE is_default GROUP BY type, name""",
        "dep", "pushes",
    ),
)
def _approx_variants(fleet: Fleet) -> DataFrame:
    """Read from the stored sketches only. As few variants as the given fleet has are counted exactly by a sketch."""
    return sketches.variants(_variant_store(fleet), ["type", "name"])


@query(
    "approx_variants_by_owner",
    with_ctes(
        """SELECT owner, type, name, count(*) AS uses, count(DISTINCT sha) AS variants FROM dep JOIN pushes USING (push_id)
        JOIN repos USING (repo) WHERE is_default AND strftime(ts, '%Y-%m') BETWEEN '1994-04' AND '1996-09' GROUP BY ALL""",
        "dep", "pushes", "repos",
    ),
)
def _approx_variants_by_owner(fleet: Fleet) -> DataFrame:
    return sketches.variants(sketches.between(_variant_store(fleet), "1994-04", "1996-09"), ["owner", "type", "name"])


@query(
    "build_time_quantiles",
    with_ctes(
        """SELECT repo, count(*) AS builds, round(avg(value), 6) AS mean_seconds, max(value) AS max_seconds,
        quantile_disc(value, 0.5) AS half_seconds, quantile_disc(value, 0.95) AS slow_seconds FROM ev WHERE kind = 'build' GROUP BY repo""",
        "ev",
    ),
)
def _build_time_quantiles(fleet: Fleet) -> DataFrame:
    """Durations per repository from stored monthly sketches."""
    location = scratch_path(fleet.spark, "build-sketches")
    builds = fleet.delivery_events().filter(F.col("kind") == "build")
    sketches.append(sketches.build_sketches(builds), location)
    found = sketches.build_quantiles(sketches.stored(fleet.spark, location), ["repo"], {"half_seconds": 0.5, "slow_seconds": 0.95})
    return found.withColumn("mean_seconds", F.round("mean_seconds", 6))
