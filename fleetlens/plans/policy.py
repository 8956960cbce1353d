"""Queries over diffs, targets and remediation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import aspects as a
from fleetlens.operators import remediate, targets
from fleetlens.operators.aspects import extract_facts
from fleetlens.operators.diff import diff_summary, fingerprint_diff
from fleetlens.plans.registry import query
from fleetlens.plans.sources import default_pushes, npm_facts, with_push_time
from fleetlens.plans.sql import LIB, with_ctes
from fleetlens.session import cut_lineage
from fleetlens.sources.driver import Fleet


def default_npm_facts(fleet: Fleet) -> DataFrame:
    return npm_facts(fleet, default_pushes(fleet))


def latest_npm(fleet: Fleet) -> DataFrame:
    return npm_facts(fleet, fleet.latest_pushes())


@query(
    "fingerprint_diff",
    with_ctes(
        """SELECT repo, push_id, 'npm-project-deps' AS type, name, CASE WHEN from_sha IS NULL THEN 'added'
        WHEN to_sha IS NULL THEN 'removed' ELSE 'changed' END AS change, from_sha, to_sha, from_data, to_data FROM (
        SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.push_id, o.push_id) AS push_id, coalesce(n.name, o.name) AS name,
        o.sha AS from_sha, n.sha AS to_sha, o.data AS from_data, n.data AS to_data
        FROM (SELECT chain.repo, dep.* FROM dep JOIN chain USING (push_id) WHERE prev_push IS NOT NULL) n FULL JOIN
        (SELECT chain.repo, next_push AS push_id, name, sha, data FROM dep JOIN chain USING (push_id)
        WHERE next_push IS NOT NULL) o ON n.push_id = o.push_id AND n.name = o.name) WHERE from_sha IS DISTINCT FROM to_sha""",
        "dep", "chain",
    ),
)
def _fingerprint_diff(fleet: Fleet) -> DataFrame:
    return fingerprint_diff(default_npm_facts(fleet), default_pushes(fleet))


def _deviations(fleet: Fleet) -> DataFrame:
    facts = cut_lineage(latest_npm(fleet), "facts")  # read twice, extracted once
    return targets.target_diff(facts, targets.modal_targets(facts))


@query(
    "target_diff",
    with_ctes(
        "SELECT repo, push_id, name, data, target_data FROM depl JOIN target USING (type, name) WHERE sha <> target_sha", "target"
    ),
)
def _target_diff(fleet: Fleet) -> DataFrame:
    return _deviations(fleet).select("repo", "push_id", "name", "data", "target_data")


_HISTORY = """SELECT name, (y + 1) || '-01-01' AS since, arg_min(data, (-n, data)) AS target_data FROM (
    SELECT name, year(ts) AS y, data, count(*) AS n FROM dep JOIN pushes USING (push_id) WHERE is_default GROUP BY ALL)
    GROUP BY name, y"""


@query(
    "target_asof",
    with_ctes(
        """SELECT repo, push_id, name, data, target_data, since FROM (SELECT f.*, h.target_data, h.since FROM
        (SELECT repo, push_id, ts, name, data FROM dep JOIN pushes USING (push_id) WHERE is_default) f
        JOIN history h ON h.name = f.name AND h.since::TIMESTAMP <= f.ts)
        QUALIFY row_number() OVER (PARTITION BY repo, push_id, name ORDER BY since DESC) = 1""",
        "dep", "pushes",
        extra={"history": _HISTORY},
    ),
)
def _target_asof(fleet: Fleet) -> DataFrame:
    """Targets are set each January from the most used version of the year before."""
    facts = cut_lineage(with_push_time(default_npm_facts(fleet), fleet), "facts")  # read twice, extracted once
    year = F.year("ts").alias("_y")
    counts = facts.groupBy("type", "name", year, "data").agg(F.count("*").alias("n"))
    chosen = counts.groupBy("type", "name", "_y").agg(
        F.min_by("data", F.struct(-F.col("n"), F.col("data"))).alias("target_data")
    )
    history = chosen.select("type", "name", "target_data", F.make_date(F.col("_y") + 1, F.lit(1), F.lit(1)).alias("valid_from"))
    joined = targets.target_asof(facts, history, fleet.as_of())
    return joined.select("repo", "push_id", "name", "data", "target_data", F.col("valid_from").cast("string").alias("since"))


@query(
    "policy_compliance",
    with_ctes(
        """SELECT type, name, count(*) AS repos, sum((sha = target_sha)::INT)::BIGINT AS on_target,
        round(avg((sha = target_sha)::INT), 6) AS share,
        sum((split_part(version, '.', 1) = regexp_extract(target_data, '(\\^[0-9]+)', 1))::INT)::BIGINT AS admitted FROM depl JOIN target USING (type, name) GROUP BY type, name""",
        "target",
    ),
)
def _policy_compliance(fleet: Fleet) -> DataFrame:
    facts = cut_lineage(latest_npm(fleet), "facts")
    return targets.policy_compliance(facts, targets.modal_targets(facts))


_PARENT_TARGET = """SELECT name, arg_min(data, (-n, data)) AS target_data, arg_min(version, (-n, data)) AS target_version
    FROM (SELECT name, data, version, count(*) AS n FROM pl GROUP BY ALL) GROUP BY name"""
_PARENT_LATEST = "SELECT latest.repo, latest.branch, parent.* FROM parent JOIN latest USING (push_id)"


@query(
    "diff_summary",
    with_ctes(
        """SELECT repo, 'npm-project-deps' AS type, name, 'New NPM Package Policy' AS title, 'Policy version for NPM package '
        || lib || ' is ' || trim(split_part(target_data, ',', 2), '"]') || '.' || chr(10) || 'Project ' || owner || '/' || repo || '/'
        || branch || ' is currently configured to use version ' || version || '.' AS description
        FROM depl JOIN target USING (type, name) JOIN repos USING (repo) WHERE sha <> target_sha UNION ALL
        SELECT repo, 'maven-parent-pom', name, 'New Maven Parent POM Version Policy', 'Policy version for Maven dependency '
        || name || ' is ' || target_version || '.' || chr(10) || 'Project ' || owner || '/' || repo || '/' || branch
        || ' is currently using version ' || version || '.'
        FROM pl JOIN pt USING (name) JOIN repos USING (repo) WHERE data <> target_data UNION ALL
        SELECT repo, 'k8s-specs', name, 'New Kubernetes Spec Policy', 'Policy version for Kubernetes spec ' || replace(name, '::', '/')
        || ' differs from that in ' || owner || '/' || repo || '/master.'
        FROM sl JOIN st USING (name) JOIN repos USING (repo) WHERE data <> target_data""",
        "target", "repos", "parent", "specs",
        extra={
            "pl": _PARENT_LATEST, "pt": _PARENT_TARGET,
            "sl": "SELECT latest.repo, specs.* FROM specs JOIN latest USING (push_id)",
            "st": """SELECT name, arg_min(data, (-n, data)) AS target_data FROM
                (SELECT name, data, count(*) AS n FROM sl GROUP BY ALL) GROUP BY name""",
        },
    ),
)
def _diff_summary(fleet: Fleet) -> DataFrame:
    latest = fleet.latest_pushes()
    files = fleet.files(["package.json", "pom.xml", "module/pom.xml", "deploy"], latest)
    facts = cut_lineage(extract_facts(files, [a.NPM, a.PARENT_POM, a.K8S]), "facts")
    deviations = targets.target_diff(facts, targets.modal_targets(facts))
    located = deviations.join(latest.select("repo", "branch"), "repo").join(fleet.repos(), "repo")
    return diff_summary(located.select(
        "owner", "repo", "branch", "type", "name", F.col("data").alias("from_data"), F.col("data").alias("to_data"), "target_data"
    ))


@query(
    "promote_target",
    with_ctes(
        """SELECT repo, push_id, channel, CASE WHEN channel IS NULL THEN 'abstain' ELSE 'set-target' END AS vote,
        CASE WHEN channel IS NOT NULL THEN 'npm-project-deps' END AS type,
        CASE WHEN channel IS NOT NULL THEN 'fleet::repo-' || repo END AS name,
        CASE WHEN channel IS NOT NULL THEN d END AS target_data, CASE WHEN channel IS NOT NULL THEN sha256(d) END AS target_sha
        FROM (SELECT chain.repo, push_id, CASE WHEN repo % 2 = 0 THEN '#' || lower(owner) END AS channel,
        '["@fleet/repo-' || repo || '","1.' || push_id % 10 || '.0"]' AS d
        FROM chain JOIN repos USING (repo) WHERE prev_push IS NOT NULL AND push_id % 10 <> prev_push % 10)""",
        "chain", "repos",
    ),
)
def _promote_target(fleet: Fleet) -> DataFrame:
    pushes = default_pushes(fleet)
    facts = extract_facts(fleet.files(["package.json"], pushes), [a.NPM_COORDINATES])
    return targets.promote_target(fingerprint_diff(facts, pushes), channels(fleet))


def channels(fleet: Fleet) -> DataFrame:
    """Every other repository talks on the channel of its owner."""
    linked = fleet.repos().filter(F.pmod("repo", F.lit(2)) == 0)
    return linked.select("repo", F.concat(F.lit("#"), F.lower("owner")).alias("channel"))


@query(
    "ideal_versions",
    with_ctes(
        """SELECT DISTINCT depl.type, depl.name, '["' || depl.lib || '","^' || top || '.0.0"]' AS ideal_data,
        sha256('["' || depl.lib || '","^' || top || '.0.0"]') AS ideal_sha, 'latest from NPM' AS reason
        FROM depl JOIN (SELECT lib, max(p_size) AS top FROM reg GROUP BY lib) USING (lib)""",
        "depl",
        extra={"reg": f"SELECT {LIB} AS lib, p_size FROM part"},
    ),
)
def _ideal_versions(fleet: Fleet) -> DataFrame:
    return targets.ideal_versions(latest_npm(fleet), fleet.registry())


_REMEDIATION = """SELECT latest.repo, latest.push_id, 'package.json' AS path, edits, sha256('{' || nl || '  "name": "@fleet/repo-'
        || latest.repo || '",' || nl || '  "version": "1.' || push_id % 10 || '.0",' || nl || '  "dependencies": '
        || coalesce('{' || nl || r || nl || '  }', '{}') || ',' || nl || '  "devDependencies": '
        || coalesce('{' || nl || d || nl || '  }', '{}') || nl || '}' || nl) AS content_sha
        FROM (SELECT *, chr(10) AS nl FROM latest) latest JOIN (SELECT push_id, count(*) AS edits FROM depl
        JOIN target USING (type, name) WHERE sha <> target_sha GROUP BY push_id) USING (push_id) JOIN (
        SELECT push_id, string_agg('    "' || lib || '": ' || v, ',' || chr(10) ORDER BY lib) FILTER (NOT dev) AS r,
        string_agg('    "' || lib || '": ' || v, ',' || chr(10) ORDER BY lib) FILTER (dev) AS d FROM (
        SELECT entry.push_id, dev, entry.lib, CASE WHEN depl.sha <> target_sha THEN trim(split_part(target_data, ',', 2), ']')
        ELSE '"^' || size || '.0.0"' END AS v FROM entry JOIN depl USING (push_id, lib) JOIN target USING (type, name))
        GROUP BY push_id) USING (push_id)"""
#: In the stand-in fleet all ranges are carets of whole versions: the target is admitted if the first number is the same.
_OUTSIDE = "split_part(version, '.', 1) <> regexp_extract(target_data, '(\\^[0-9]+)', 1)"


@query("npm_remediation", with_ctes(_REMEDIATION, "target", "latest", "entry"))
def _npm_remediation(fleet: Fleet) -> DataFrame:
    return _remediated(fleet, targets.target_diff)


@query(
    "npm_range_remediation",
    with_ctes(_REMEDIATION.replace("depl.sha <> target_sha", _OUTSIDE).replace("sha <> target_sha", _OUTSIDE), "target", "latest", "entry"),
)
def _npm_range_remediation(fleet: Fleet) -> DataFrame:
    """Only libraries whose declared range does not let the target in are edited."""
    return _remediated(fleet, lambda facts, policy: targets.outside_range(targets.target_diff(facts, policy)))


def _remediated(fleet: Fleet, deviating) -> DataFrame:
    files = fleet.files(["package.json"], fleet.latest_pushes())
    facts = cut_lineage(extract_facts(files, [a.NPM]), "facts")
    fixed = remediate.npm_remediation(files, deviating(facts, targets.modal_targets(facts)))
    return fixed.select("repo", "push_id", "path", "edits", F.sha2("content", 256).alias("content_sha"))


_RESOLVED = """SELECT u.lib, u.range, u.uses, r.version AS resolved, n.version AS newest, CASE WHEN n.size IS NULL THEN NULL
    WHEN u.size < n.size THEN 'major' WHEN u.size > n.size THEN 'none' WHEN coalesce(r.minor, 0) < n.minor THEN 'minor' WHEN coalesce(r.minor, 0) > n.minor
    THEN 'none' WHEN coalesce(r.patch, 0) < n.patch THEN 'patch' ELSE 'none' END AS drift
    FROM (SELECT lib, version AS range, substr(split_part(version, '.', 1), 2)::BIGINT AS size, count(*) AS uses FROM depl GROUP BY ALL) u
    LEFT JOIN (SELECT * FROM reg WHERE NOT rc QUALIFY row_number() OVER (PARTITION BY lib, size ORDER BY minor DESC, patch DESC) = 1) r
    ON r.lib = u.lib AND r.size = u.size LEFT JOIN
    (SELECT * FROM reg WHERE NOT rc QUALIFY row_number() OVER (PARTITION BY lib ORDER BY size DESC, minor DESC, patch DESC) = 1) n ON n.lib = u.lib"""
_REG = {"reg": f"""SELECT {LIB} AS lib, p_size AS size, p_partkey % 7 AS minor, p_partkey % 5 AS patch, p_partkey % 4 = 0 AS rc,
    p_size || '.' || p_partkey % 7 || '.' || p_partkey % 5 AS version FROM part"""}


@query("npm_resolution", with_ctes(_RESOLVED, "depl", extra=_REG))
def _npm_resolution(fleet: Fleet) -> DataFrame:
    """What every declared range resolves to among the published versions, and how far that is behind."""
    return targets.resolved_versions(latest_npm(fleet), fleet.published_versions())


@query(
    "version_drift",
    with_ctes(
        f"""SELECT lib, sum(uses)::BIGINT AS uses, {", ".join(f"coalesce(sum(uses) FILTER (drift = '{d}'), 0)::BIGINT AS {c}" for d, c in (("major", "major"), ("minor", "minor"), ("patch", "patch"), ("none", "current")))}
        FROM ({_RESOLVED}) GROUP BY lib""",
        "depl",
        extra=_REG,
    ),
)
def _version_drift(fleet: Fleet) -> DataFrame:
    return targets.version_drift(targets.resolved_versions(latest_npm(fleet), fleet.published_versions()))


@query(
    "parent_pom_remediation",
    with_ctes(
        """SELECT repo, push_id, path, 1::BIGINT AS edits, grp, artifact, target_version AS version
        FROM pl JOIN pt USING (name) WHERE data <> target_data""",
        "parent", "latest",
        extra={"pl": _PARENT_LATEST, "pt": _PARENT_TARGET},
    ),
)
def _parent_pom_remediation(fleet: Fleet) -> DataFrame:
    """Rewritten POMs are read again: the parent found there is the target."""
    keys = ["repo", "push_id", "path"]
    files = fleet.files(["pom.xml", "module/pom.xml"], fleet.latest_pushes())
    facts = cut_lineage(extract_facts(files, [a.PARENT_POM], keys), "facts")
    fixed = remediate.parent_pom_remediation(files, targets.target_diff(facts, targets.modal_targets(facts)))
    reread = extract_facts(fixed, [a.PARENT_POM], [*keys, "edits"])
    fields = [F.get_json_object("data", f"$.{f}").alias(c) for f, c in (("group", "grp"), ("artifact", "artifact"), ("version", "version"))]
    return reread.select(*keys, "edits", *fields)


@query(
    "k8s_remediation",
    with_ctes(
        """SELECT repo, push_id, path, name, CASE WHEN path = 'deploy.json' THEN target_data ELSE
        'apiVersion: apps/v1' || chr(10) || 'kind: Deployment' || chr(10) || 'metadata:' || chr(10) || '  labels:' || chr(10)
        || '    app: ' || first || chr(10) || '  name: ' || first || chr(10) || '  namespace: fleet' || chr(10) || 'spec:'
        || chr(10) || '  replicas: ' || replicas || chr(10) END AS content FROM (
        SELECT sl.*, st.*, regexp_extract(target_data, 'replicas":([0-9]+)', 1) AS replicas, replace(sl.name, 'Deployment::fleet::', '')
        AS first FROM sl JOIN st ON sl.name = st.target_name)""",
        "specs", "latest",
        extra={
            "sl": "SELECT latest.repo, specs.* FROM specs JOIN latest USING (push_id)",
            "st": """SELECT name AS target_name, arg_min(data, (-n, data)) AS target_data FROM
                (SELECT name, data, count(*) AS n FROM sl GROUP BY ALL) GROUP BY name""",
        },
    ),
)
def _k8s_remediation(fleet: Fleet) -> DataFrame:
    files = fleet.files(["deploy"], fleet.latest_pushes())
    specs = cut_lineage(extract_facts(files, [a.K8S], ["repo", "push_id", "path"]), "facts")
    return remediate.k8s_remediation(specs, targets.modal_targets(specs).select("type", "name", "target_data"))


@query(
    "typescript_remediation",
    with_ctes(
        """SELECT repo, push_id, 'package.json' AS path, 'devDependencies' AS section, 'typescript' AS lib,
        trim(target, '[]"') AS version FROM (SELECT latest.repo, ts.* FROM ts JOIN latest USING (push_id)),
        (SELECT arg_min(data, (-n, data)) AS target FROM (SELECT data, count(*) AS n FROM ts JOIN latest USING (push_id) GROUP BY data))
        WHERE data <> target AND NOT contains(target, ',')""",
        "ts", "latest",
    ),
)
def _typescript_remediation(fleet: Fleet) -> DataFrame:
    facts = cut_lineage(extract_facts(fleet.files(["package.json"], fleet.latest_pushes()), [a.TYPESCRIPT]), "facts")
    return remediate.typescript_remediation(facts, targets.modal_targets(facts))
