"""Queries over sources, scopes and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import aspects as a
from fleetlens.operators.aspects import extract_facts
from fleetlens.operators.presence import assign_projects, virtual_projects
from fleetlens.operators.reports import usage
from fleetlens.plans.registry import query
from fleetlens.plans.sql import with_ctes
from fleetlens.session import cut_lineage, scratch_path
from fleetlens.sources.content_store import ContentStore
from fleetlens.sources.driver import Fleet
from fleetlens.sources.fact_store import FactStore
from fleetlens.sources.files import files_by_glob, files_by_path
from fleetlens.sources.store import as_documents, incremental_scope, latest_state, repo_scope, upsert

STORED_BEFORE = "2000-01-01"


def npm_facts(fleet: Fleet, scope: DataFrame | None = None) -> DataFrame:
    return extract_facts(fleet.files(["package.json"], scope), [a.NPM])


def with_push_time(facts: DataFrame, fleet: Fleet) -> DataFrame:
    return facts.join(fleet.pushes().select("push_id", "ts"), "push_id")


def default_pushes(fleet: Fleet) -> DataFrame:
    return fleet.pushes().filter("is_default")


@query(
    "files_by_path",
    with_ctes(
        """SELECT repo, push_id, 'requirements.txt' AS path, '# runtime requirements' || chr(10) || chr(10)
        || string_agg(brand || ' == ' || size || '   # pinned', chr(10) ORDER BY brand) || chr(10) || '-r other.txt' || chr(10)
        AS content FROM bl JOIN pushes USING (push_id) WHERE p_type = 'SMALL' GROUP BY repo, push_id""",
        "bl", "pushes",
    ),
)
def _files_by_path(fleet: Fleet) -> DataFrame:
    return files_by_path(fleet.files(["requirements.txt", "pom.xml"]), "requirements.txt")


@query(
    "files_by_glob",
    with_ctes(
        """SELECT '*.csproj' AS glob, repo, push_id, 'App.csproj' AS path FROM kinds JOIN pushes USING (push_id)
        WHERE p_type = 'ECONOMY' UNION ALL
        SELECT '**/pom.xml', repo, push_id, path FROM kinds JOIN pushes USING (push_id),
        (VALUES ('pom.xml'), ('module/pom.xml')) v(path) WHERE p_type = 'PROMO' UNION ALL
        SELECT '*.@(json|yaml|yml)', repo, push_id, CASE WHEN push_id % 2 = 0 THEN 'deploy.json' ELSE 'deploy.yml' END
        FROM kinds JOIN pushes USING (push_id) WHERE p_type = 'LARGE'""",
        "kinds", "pushes",
    ),
)
def _files_by_glob(fleet: Fleet) -> DataFrame:
    files = fleet.files(["App.csproj", "sub/Other.csproj", "pom.xml", "module/pom.xml", "deploy"])
    out = None
    for glob in ("*.csproj", "**/pom.xml", "*.@(json|yaml|yml)"):
        found = files_by_glob(files, glob).select(F.lit(glob).alias("glob"), "repo", "push_id", "path")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "repo_scope",
    with_ctes("SELECT repo, push_id, branch FROM pushes JOIN repos USING (repo) WHERE owner = 'NATION_3'", "pushes", "repos"),
)
def _repo_scope(fleet: Fleet) -> DataFrame:
    scope = repo_scope(fleet.repos(), "NATION_3")
    return fleet.pushes().join(scope, "repo", "left_semi").select("repo", "push_id", "branch")


@query(
    "incremental_scope",
    with_ctes(f"SELECT repo, push_id FROM pushes WHERE is_default AND ts >= TIMESTAMP '{STORED_BEFORE}'", "pushes"),
)
def _incremental_scope(fleet: Fleet) -> DataFrame:
    scope = default_pushes(fleet).select("repo", "push_id")
    stored = default_pushes(fleet).filter(F.col("ts") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))
    return incremental_scope(scope, stored)


@query(
    "incremental_facts",
    with_ctes(
        """SELECT repo, push_id, type, name, data, sha256(data) AS sha FROM (
        SELECT push_id, 'python-direct-dep' AS type, name, data FROM py UNION ALL
        SELECT push_id, 'docker-base-image', 'registry/' || brand, '{"image":"registry/' || brand || '","version":"' || size || '"}' FROM bl
        WHERE p_type = 'LARGE') JOIN pushes USING (push_id) WHERE is_default""",
        "py", "bl", "pushes",
    ),
)
def _incremental_facts(fleet: Fleet) -> DataFrame:
    """Pushes are analysed in two runs over one store; the second reads only contents that the first has not seen."""
    store = ContentStore(fleet.spark, scratch_path(fleet.spark, "contents"), [a.PYTHON, a.DOCKER_FROM])
    pushes = default_pushes(fleet)
    files = lambda scope: fleet.files(["requirements.txt", "Dockerfile"], scope)
    store.add(files(pushes.filter(F.col("ts") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))))
    return store.extract(files(pushes), ["repo", "push_id"]).select("repo", "push_id", "type", "name", "data", "sha")


@query(
    "virtual_projects",
    with_ctes(
        """SELECT repo, push_id, path, CASE WHEN path = 'module/pom.xml' THEN 'module' ELSE '' END AS project FROM (
        SELECT repo, push_id, 'package.json' AS path FROM pushes UNION ALL
        SELECT repo, push_id, path FROM kinds JOIN pushes USING (push_id), (VALUES ('PROMO', 'pom.xml'),
        ('PROMO', 'module/pom.xml'), ('ECONOMY', 'App.csproj'), ('ECONOMY', 'sub/Other.csproj')) v(t, path) WHERE t = p_type)""",
        "kinds", "pushes",
    ),
)
def _virtual_projects(fleet: Fleet) -> DataFrame:
    files = fleet.files(["package.json", "pom.xml", "module/pom.xml", "App.csproj", "sub/Other.csproj"])
    return assign_projects(files, virtual_projects(files))


@query(
    "store_upsert",
    with_ctes(
        """SELECT repo, type, name, push_id, sha FROM dep JOIN pushes USING (push_id) WHERE is_default
        QUALIFY row_number() OVER (PARTITION BY repo, type, name ORDER BY ts DESC, push_id DESC, sha DESC) = 1""",
        "dep", "pushes",
    ),
)
def _store_upsert(fleet: Fleet) -> DataFrame:
    pushes = default_pushes(fleet).select("repo", "push_id", "ts", "priority")
    early = F.col("ts") < F.lit(STORED_BEFORE).cast("timestamp_ntz")

    def analysis(scope: DataFrame) -> DataFrame:
        return with_push_time(npm_facts(fleet, scope), fleet).select("repo", "type", "name", "push_id", "ts", "sha")

    merged = upsert(analysis(pushes.filter(early)), analysis(pushes.filter(~early)))
    return merged.select("repo", "type", "name", "push_id", "sha")


@query(
    "fact_store",
    with_ctes(
        """SELECT repo, type, name, push_id, sha FROM dep JOIN pushes USING (push_id) WHERE is_default
        QUALIFY row_number() OVER (PARTITION BY repo, type, name ORDER BY ts DESC, push_id DESC, sha DESC) = 1""",
        "dep", "pushes",
    ),
)
def _fact_store(fleet: Fleet) -> DataFrame:
    """Three periods arrive at a bucketed store, the newest before the middle one, with a compaction between."""
    facts = with_push_time(npm_facts(fleet, default_pushes(fleet)), fleet).select("repo", "type", "name", "push_id", "ts", "sha")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in facts.schema)
    store = FactStore(fleet.spark, scratch_path(fleet.spark, "fact-store"), schema, int(fleet.spark.conf.get("spark.sql.shuffle.partitions")))
    facts = cut_lineage(facts, "facts")
    periods = [F.year("ts") < 1997, F.year("ts") >= 1999, F.year("ts").between(1997, 1998)]
    for i, period in enumerate(periods):
        store.upsert(facts.filter(period))
        if i == 1:
            store.compact()
    return store.read().select("repo", "type", "name", "push_id", "sha")


@query("latest_state", with_ctes("SELECT repo, push_id, type, name, sha FROM depl", "depl"))
def _latest_state(fleet: Fleet) -> DataFrame:
    latest = fleet.latest_pushes()
    return latest_state(npm_facts(fleet, latest), latest).select("repo", "push_id", "type", "name", "sha")


@query(
    "json_report_sink",
    with_ctes(
        """SELECT name, '{"type":"' || type || '","name":"' || name || '","repos":' || count(DISTINCT repo) || '}' AS document
        FROM depl GROUP BY type, name""",
        "depl",
    ),
)
def _json_report_sink(fleet: Fleet) -> DataFrame:
    return as_documents(usage(npm_facts(fleet, fleet.latest_pushes())), ["name"])
