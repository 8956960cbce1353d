"""Queries over the extractors: one per kind of fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.documents import with_document_and_spec
from fleetlens.functions.payload import canonical_json, canonical_sha, sha_of
from fleetlens.functions.text import unix_lines
from fleetlens.operators import aspects as a
from fleetlens.operators import extractors as x
from fleetlens.operators import presence
from fleetlens.operators.aspects import extract_facts, rejects
from fleetlens.operators.ci import document_shas, travis_profile
from fleetlens.operators.maven import effective_models, resolve
from fleetlens.plans.registry import query
from fleetlens.plans.sql import envelope, with_ctes
from fleetlens.sources.driver import FAMILIES, PLATFORMS, PRIORITY_FILES, Fleet

FACT = "repo, push_id, type, name, abbreviation, version, data, sha256(data) AS sha"


def _facts(name: str, aspect: a.Aspect, kinds: list[str], sql: str, *ctes: str) -> None:
    """Register the extraction of one aspect over all snapshots."""

    @query(name, with_ctes(f"SELECT {FACT} FROM ({sql})", *ctes, "pushes"))
    def job(fleet: Fleet) -> DataFrame:
        return extract_facts(fleet.files(kinds), [aspect])


# --- Node ---------------------------------------------------------------

_facts(
    "npm_deps", a.NPM, ["package.json"],
    f"SELECT repo, push_id, {envelope('npm-project-deps', 'npmdeps', '0.0.1')}, name, data FROM "
    "(SELECT push_id, name, data FROM dep) JOIN pushes USING (push_id)",
    "dep",
)

_facts(
    "npm_coordinates", a.NPM_COORDINATES, ["package.json"],
    f"""SELECT repo, push_id, {envelope(x.NPM_COORDINATES, x.NPM_COORDINATES, '0.0.1')}, type AS name,
    '{{"name":"@fleet/repo-' || repo || '","version":"1.' || push_id % 10 || '.0"}}' AS data FROM pushes""",
)

_facts(
    "typescript_version", a.TYPESCRIPT, ["package.json"],
    f"SELECT repo, push_id, {envelope(x.TYPESCRIPT, 'tsv', '0.1.0')}, type AS name, data FROM ts JOIN pushes USING (push_id)",
    "ts",
)

_facts(
    "tslint_rules", a.TSLINT, ["tslint.json"],
    f"""SELECT repo, push_id, {envelope(x.TSLINT)}, 'rules:' || brand AS name, '{{"path":"rules","property":"' || brand
    || '","value":' || CASE size % 4 WHEN 0 THEN 'true' WHEN 1 THEN '""' WHEN 2 THEN size::VARCHAR
    ELSE '[true,' || size || ']' END || '}}' AS data FROM bl JOIN pushes USING (push_id) WHERE p_type = 'ECONOMY'""",
    "bl",
)


@query(
    "rejects",
    with_ctes(
        """SELECT repo, push_id, 'package.json' AS path, 'npm-project-deps' AS aspect, 'not JSON' AS error
        FROM pushes WHERE priority = '5-LOW'""",
        "pushes",
    ),
)
def _rejects(fleet: Fleet) -> DataFrame:
    """Snapshots of the lowest priority arrive with a truncated manifest."""
    low = fleet.pushes().filter("priority = '5-LOW'").select("repo", "push_id").withColumn("_low", F.lit(True))
    files = fleet.files(["package.json", ".travis.yml", "tslint.json"]).join(low, ["repo", "push_id"], "left")
    torn = F.col("_low") & (F.col("path") == "package.json")
    return rejects(files.withColumn("content", F.when(torn, F.expr("left(content, 20)")).otherwise(F.col("content"))))


# --- Python, JVM, .NET, Clojure -------------------------------------------

_facts(
    "python_deps", a.PYTHON, ["requirements.txt"],
    f"SELECT repo, push_id, {envelope(x.PYTHON, 'pydep', '0.1.0')}, name, data FROM py JOIN pushes USING (push_id)",
    "py",
)

_facts(
    "maven_parent_pom", a.PARENT_POM, ["pom.xml", "module/pom.xml"],
    f"""SELECT repo, push_id, {envelope(x.PARENT_POM, 'mvnp', '0.1.0')}, name, data
    FROM (SELECT push_id, name, data FROM parent) JOIN pushes USING (push_id)""",
    "parent",
)

_facts(
    "maven_direct_deps", a.MAVEN_DIRECT, ["pom.xml"],
    f"SELECT repo, push_id, {envelope(x.MAVEN_DIRECT, 'mvn', '0.1.0')}, name, data FROM mvnd JOIN pushes USING (push_id)",
    "mvnd",
)

_facts(
    "spring_boot_starters", a.STARTER, ["pom.xml"],
    f"""SELECT repo, push_id, {envelope(x.STARTER)}, 'starter:' || name AS name, data FROM mvnd JOIN pushes USING (push_id)
    WHERE contains(artifact, '-starter')""",
    "mvnd",
)

_facts(
    "spring_boot_version", a.BOOT_VERSION, ["pom.xml"],
    f"""SELECT repo, push_id, '{x.BOOT_VERSION}' AS type, NULL::VARCHAR AS abbreviation, NULL::VARCHAR AS version,
    '{x.BOOT_VERSION}' AS name, '{{"versions":[{{"version":"' || boot || '"}}]}}' AS data
    FROM (SELECT push_id, version AS boot FROM pom WHERE grp = 'org.springframework.boot') JOIN pushes USING (push_id)""",
    "pom",
)

_facts(
    "lein_deps", a.LEIN, ["project.clj"],
    f"""SELECT repo, push_id, {envelope(x.LEIN)}, brand || '/lib' AS name, '["' || brand || '/lib","1.' || size || '.0"]' AS data
    FROM bl JOIN pushes USING (push_id) WHERE p_type = 'SMALL' AND priority = '3-MEDIUM'""",
    "bl",
)


@query(
    "maven_all_deps",
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 1),
    c AS (SELECT src, dst, 1::BIGINT AS depth FROM e UNION ALL SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON c.dst = e.src)
    SELECT src, dst, min(depth) AS depth, min(depth) = 1 AS direct FROM c GROUP BY src, dst""",
)
def _maven_all_deps(fleet: Fleet) -> DataFrame:
    """Resolved from the text of the POMs; a part's POM declares the part of half its key."""
    models = effective_models(fleet.chain_poms())
    number = lambda c, i: F.regexp_extract(c, "part-([0-9]+)", i).cast("bigint")
    found = resolve(models, models.select(F.col("id").alias("root")))
    return found.select(number("root", 1).alias("src"), number("artifact", 1).alias("dst"), "depth", "direct")


def _resolved_sql(rounds: int = 20) -> str:
    """Nearest version of every family, one expression a round; 20 rounds reach down from keys below 2^20."""
    pin = lambda k: f"CASE WHEN {k} % {FAMILIES} = root % {PLATFORMS} THEN {k} % {FAMILIES} + {FAMILIES} ELSE {k} END"
    step = f"""SELECT root, k, scope, path, banned, '1' AS step, k // 2 AS c, 'compile' AS own, false AS optional,
        CASE WHEN k % 7 = 0 THEN list_append(banned, (k // 4) % {FAMILIES}) ELSE banned END AS next_banned FROM {{t}} WHERE k // 2 > 0 UNION ALL
        SELECT root, k, scope, path, banned, '2', k // 3, CASE k % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'runtime' ELSE 'compile' END, k % 11 = 0, banned
        FROM {{t}} WHERE k // 3 > 0"""
    parts = ["p0 AS (SELECT p_partkey AS root, p_partkey AS k, 'compile' AS scope, '' AS path, []::BIGINT[] AS banned FROM part WHERE p_partkey >= 1)",
             f"t0 AS (SELECT root, root % {FAMILIES} AS family FROM p0)"]
    for i in range(1, rounds + 1):
        low = "" if i == 1 else " AND NOT optional AND own <> 'test'"
        scope = "own" if i == 1 else "CASE WHEN scope = 'compile' THEN own ELSE scope END"
        version = "k" if i == 1 else pin("k")
        parts += [
            f"e{i} AS ({step.format(t=f'p{i - 1}')})",
            f"""c{i} AS (SELECT root, c AS k, {scope} AS scope, path || step AS path, next_banned AS banned FROM e{i}
                WHERE NOT list_contains(banned, c % {FAMILIES}){low})""",
            f"""b{i} AS (SELECT root, k % {FAMILIES} AS family, arg_min(k, path) AS k, arg_min(scope, path) AS scope, min(path) AS path, arg_min(banned, path) AS banned
                FROM c{i} WHERE NOT EXISTS (SELECT 1 FROM t{i - 1} t WHERE t.root = c{i}.root AND t.family = c{i}.k % {FAMILIES}) GROUP BY ALL)""",
            f"p{i} AS (SELECT root, {version} AS k, scope, path, banned FROM b{i})",
            f"t{i} AS (SELECT * FROM t{i - 1} UNION ALL SELECT root, family FROM b{i})",
        ]
    found = " UNION ALL ".join(f"SELECT root, k, scope, {i} AS depth FROM p{i}" for i in range(1, rounds + 1))
    return f"""WITH {", ".join(parts)} SELECT root AS part, 'com.fleet:fam-' || k % {FAMILIES} AS name, k::VARCHAR AS version, scope,
        depth::BIGINT AS depth, depth = 1 AS direct FROM ({found})"""


@query("maven_resolved", _resolved_sql())
def _maven_resolved(fleet: Fleet) -> DataFrame:
    """Dependency mediation: parents, properties, management, scopes, exclusions, nearest versions."""
    models = effective_models(fleet.family_poms())
    roots = models.filter(F.col("artifact").startswith("fam-")).select(F.col("id").alias("root"))
    found = resolve(models, roots)
    part = F.element_at(F.split("root", ":"), 3).cast("bigint").alias("part")
    return found.select(part, F.concat_ws(":", "group", "artifact").alias("name"), "version", "scope", "depth", "direct")


@query(
    "target_frameworks",
    with_ctes(
        f"""SELECT {FACT} FROM (SELECT repo, push_id, {envelope(x.FRAMEWORKS)}, type AS name,
        '{{"glob":"*.csproj","matches":[{{"path":"App.csproj","matchValue":"' || v || '"}}]}}' AS data FROM (
        SELECT push_id, string_agg('net' || size, ';' ORDER BY size) AS v FROM
        (SELECT DISTINCT push_id, size FROM bl WHERE p_type = 'ECONOMY') GROUP BY push_id) JOIN pushes USING (push_id))""",
        "bl", "pushes",
    ),
)
def _target_frameworks(fleet: Fleet) -> DataFrame:
    return presence.target_frameworks(fleet.files(["App.csproj", "sub/Other.csproj"]))


@query(
    "markup_match",
    """SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, 0::BIGINT AS push_id, 'pages/' || page_id || '.html' AS path,
    generate_subscripts(m, 1) - 1 AS match_index, unnest(m) AS match_value
    FROM (SELECT *, regexp_extract_all(html, 'href="([^"]*)"', 1) AS m FROM pages)""",
)
def _markup_match(fleet: Fleet) -> DataFrame:
    return presence.markup_match(fleet.markup_files(), "**/*.html", 'href="([^"]*)"')


# --- CI and Kubernetes --------------------------------------------------------

_facts(
    "travis_scripts", a.TRAVIS, [".travis.yml"],
    f"SELECT repo, push_id, {envelope(x.TRAVIS)}, type AS name, data FROM travis JOIN pushes USING (push_id)",
    "travis",
)


@query(
    "travis_profile",
    with_ctes(
        """SELECT repo, push_id, 'java' AS language, scripts, services, CASE WHEN n > 1 THEN 'master' END AS only_branches,
        CASE WHEN n > 1 THEN '' END AS except_branches, '' AS before_install, '' AS after_success, '' AS node_js,
        NULL::VARCHAR AS addons FROM travis JOIN pushes USING (push_id)""",
        "travis", "pushes",
    ),
)
def _travis_profile(fleet: Fleet) -> DataFrame:
    lists = ["scripts", "services", "before_install", "after_success", "node_js"]
    return travis_profile(fleet.files([".travis.yml"])).select(
        "repo", "push_id", "language",
        *[F.array_join(c, ",").alias(c) for c in lists],
        F.array_join("only", ",").alias("only_branches"), F.array_join("except", ",").alias("except_branches"), "addons",
    )


@query(
    "yaml_or_json_ingest",
    with_ctes(
        """SELECT repo, push_id, path, data AS document, sha256(data) AS sha FROM (
        SELECT push_id, path, raw_data AS data FROM deploy UNION ALL
        SELECT push_id, '.travis.yml', CASE WHEN n = 1 THEN '{"language":"java","script":"' || scripts || '","services":"'
        || services || '"}' ELSE '{"branches":{"only":["master"]},"jdk":["openjdk8"],"language":"java","script":' || data
        || ',"services":["' || replace(services, ',', '","') || '"]}' END FROM travis) JOIN pushes USING (push_id)""",
        "deploy", "travis", "pushes",
    ),
)
def _yaml_or_json_ingest(fleet: Fleet) -> DataFrame:
    return document_shas(fleet.files(["deploy", ".travis.yml"]))


_facts(
    "k8s_specs", a.K8S, ["deploy", ".travis.yml"],
    f"""SELECT repo, push_id, {envelope(x.K8S, 'k8sspecs', '0.0.1')}, name, data FROM
    (SELECT push_id, name, data FROM specs) JOIN pushes USING (push_id)""",
    "specs",
)


@query(
    "k8s_normalise",
    with_ctes(
        """SELECT repo, push_id, path, sha256(raw_data) AS raw_sha, sha256(data) AS sha FROM deploy
        JOIN pushes USING (push_id)""",
        "deploy", "pushes",
    ),
)
def _k8s_normalise(fleet: Fleet) -> DataFrame:
    """Hash of each resource with and without its managed-by label. A file is rendered, read and parsed once; files of one
    path of one push are paired with all resources of that path."""
    keys = ["repo", "push_id", "path"]
    files = with_document_and_spec(fleet.files(["deploy"]).dropna(subset=keys))
    facts = F.when(a.K8S.applies(F.col("path")), a.K8S.items(F.col("spec")))
    hashes = files.select(
        *keys,
        F.struct(sha_of(canonical_json(F.col("document"))).alias("raw_sha")).alias("raw"),
        F.transform(facts, lambda f: F.struct(sha_of(f["data"]).alias("sha"))).alias("facts"),
    )
    by_path = hashes.groupBy(*keys).agg(F.collect_list("raw").alias("raw"), F.flatten(F.collect_list("facts")).alias("facts"))
    return by_path.select(*keys, F.explode("raw").alias("raw"), "facts").select(*keys, "raw", F.explode("facts").alias("fact")).select(*keys, "raw.raw_sha", "fact.sha")


# --- classification and presence ----------------------------------------------

# priority of a push -> files that come with it, as SQL conditions
_P = {p: f"priority = '{p}'" for p in PRIORITY_FILES}


def _classified(name: str, rules: list[tuple[str, list[str], str]], kinds: list[str]) -> str:
    """SQL of a classification: conditions with tags and reason, in rule order."""
    tags = ", ".join(f"CASE WHEN {cond} THEN '{t}' END" for cond, ts, _ in rules for t in ts)
    reasons = ", ".join(f"CASE WHEN {cond} THEN '\"{r}\"' END" for cond, _, r in rules)
    return with_ctes(
        f"""SELECT {FACT} FROM (SELECT repo, push_id, {envelope(name)}, type AS name, '{{"tags":["'
        || array_to_string(list_sort(list_distinct(list_filter([{tags}], lambda t: t IS NOT NULL))), '","') || '"],"reasons":['
        || concat_ws(',', {reasons}) || ']}}' AS data FROM (SELECT p.*, coalesce(has, []) AS has FROM pushes p LEFT JOIN
        (SELECT push_id, list(DISTINCT p_type) AS has FROM lp GROUP BY push_id) USING (push_id))
        WHERE {" OR ".join(cond for cond, _, _ in rules)})""",
        "lp", "pushes",
    )


def _has(kind: str) -> str:
    return f"list_contains(has, '{kind}')"


def _classify_only(fleet: Fleet, aspect: str, kinds: list[str]) -> DataFrame:
    rules = [r for r in presence.CLASSIFICATION_RULES if r.aspect == aspect]
    return presence.classify(fleet.files(kinds), rules)


@query(
    "stack",
    _classified(
        "stack",
        [
            (_has("PROMO"), ["jvm"], "has Maven POM"),
            (_P["5-LOW"], ["jvm"], "has build.gradle"),
            ("true", ["node"], "has package.json"),
            (_has("SMALL"), ["python"], "has requirements.txt"),
            (_P["5-LOW"], ["python"], "has Python files in root"),
            (_P["4-NOT SPECIFIED"], ["aws", "lambda"], "has Lambda template"),
        ],
        [],
    ),
)
def _stack(fleet: Fleet) -> DataFrame:
    return _classify_only(fleet, "stack", ["package.json", "pom.xml", "requirements.txt", "priority"])


@query(
    "java_build",
    _classified(
        "javaBuild",
        [(_has("PROMO"), ["maven"], "has Maven POM"), (_P["5-LOW"], ["gradle"], "has build.gradle")],
        [],
    ),
)
def _java_build(fleet: Fleet) -> DataFrame:
    return _classify_only(fleet, "javaBuild", ["pom.xml", "priority"])


@query(
    "ci_tool",
    _classified(
        "ci",
        [
            (_has("MEDIUM"), ["travis"], "has .travis.yml"),
            (_P["3-MEDIUM"], ["jenkins"], "has JenkinsFile"),
            (_P["2-HIGH"], ["circle"], "has .circleci/config.yml"),
        ],
        [],
    ),
)
def _ci_tool(fleet: Fleet) -> DataFrame:
    return _classify_only(fleet, "ci", [".travis.yml", "priority"])


def _glob_sql(name: str, glob: str, path: str, cond: str) -> str:
    return f"""SELECT repo, push_id, {envelope(name)}, type AS name, '{{"glob":"{glob}","matches":['
    || CASE WHEN {cond} THEN '{{"path":"{path}"}}' ELSE '' END || ']}}' AS data FROM h"""


@query(
    "file_match",
    with_ctes(
        f"SELECT {FACT} FROM ("
        + " UNION ALL ".join(
            [
                _glob_sql("csproject", "*.csproj", "App.csproj", _has("ECONOMY")),
                _glob_sql("snyk", ".snyk", ".snyk", _P["4-NOT SPECIFIED"]),
                _glob_sql("azure-pipelines", "azure-pipelines.yml", "azure-pipelines.yml", _P["5-LOW"]),
                _glob_sql("readme", "README.md", "README.md", _has("STANDARD")),
            ]
        )
        + ")",
        "lp", "pushes",
        extra={"h": """SELECT p.*, coalesce(has, []) AS has FROM pushes p LEFT JOIN
            (SELECT push_id, list(DISTINCT p_type) AS has FROM lp GROUP BY push_id) USING (push_id)"""},
    ),
)
def _file_match(fleet: Fleet) -> DataFrame:
    return presence.file_match(fleet.files(["package.json", "App.csproj", "sub/Other.csproj", "README.md", "priority"]))


def _presence(key: str, name: str, glob: str, condition: str) -> None:
    @query(key, with_ctes(f"SELECT repo, push_id, '{name}' AS name, {condition} AS present FROM pushes", "pushes"))
    def job(fleet: Fleet) -> DataFrame:
        return presence.presence(fleet.files(["package.json", "priority"]), {name: glob})


_presence("changelog_presence", "changelog", "CHANGELOG.md", _P["3-MEDIUM"])
_presence("contributing_presence", "contributing", "CONTRIBUTING.md", _P["4-NOT SPECIFIED"])


@query(
    "code_of_conduct",
    with_ctes(
        """SELECT repo, push_id, 'CODE_OF_CONDUCT.md' AS path, sha256('# code of conduct be kind.') AS sha FROM pushes
        WHERE priority = '4-NOT SPECIFIED'""",
        "pushes",
    ),
)
def _code_of_conduct(fleet: Fleet) -> DataFrame:
    """Presence and a hash of the text without case and line layout, so that re-wrapped copies are equal."""
    text = F.trim(F.regexp_replace(F.lower(unix_lines(F.col("content"))), "\\s+", " "))
    files = fleet.files(["priority"]).filter(F.col("path") == "CODE_OF_CONDUCT.md")
    return files.select("repo", "push_id", "path", sha_of(text).alias("sha"))


_facts(
    "license", a.LICENSE, ["priority"],
    f"""SELECT repo, push_id, {envelope(x.LICENSE)}, type AS name, '{{"classification":"'
    || CASE priority WHEN '1-URGENT' THEN 'MIT' ELSE 'Apache-2.0' END || '"}}' AS data FROM pushes
    WHERE priority IN ('1-URGENT', '2-HIGH')""",
)


@query(
    "license_presence",
    with_ctes(
        f"""SELECT {FACT} FROM (SELECT repo, push_id, {envelope('license-presence')}, type AS name,
        '{{"present":' || (priority IN ('1-URGENT', '2-HIGH')) || '}}' AS data FROM pushes)""",
        "pushes",
    ),
)
def _license_presence(fleet: Fleet) -> DataFrame:
    facts = extract_facts(fleet.files(["priority"]), [a.LICENSE])
    return presence.license_presence(facts, fleet.pushes())


_facts(
    "code_ownership", a.OWNERSHIP, ["priority"],
    f"""SELECT repo, push_id, {envelope(x.OWNERSHIP)}, pattern AS name, '["' || pattern || '","' || o || '"]' AS data
    FROM pushes, (VALUES ('*', '@fleet/all'), ('docs/', '@fleet/docs'), ('docs/', '@fleet/web')) v(pattern, o)
    WHERE priority = '2-HIGH'""",
)

_facts(
    "docker_from", a.DOCKER_FROM, ["Dockerfile"],
    f"""SELECT repo, push_id, {envelope(x.DOCKER_FROM)}, 'registry/' || brand AS name,
    '{{"image":"registry/' || brand || '","version":"' || size || '"}}' AS data FROM bl JOIN pushes USING (push_id)
    WHERE p_type = 'LARGE'""",
    "bl",
)

_facts(
    "dockerfile_path", a.DOCKER_PATH, ["Dockerfile"],
    f"""SELECT repo, push_id, {envelope(x.DOCKER_PATH)}, 'Dockerfile' AS name, '["Dockerfile"]' AS data
    FROM kinds JOIN pushes USING (push_id) WHERE p_type = 'LARGE'""",
    "kinds",
)

_facts(
    "docker_ports", a.DOCKER_PORTS, ["Dockerfile"],
    f"""SELECT repo, push_id, {envelope(x.DOCKER_PORTS)}, type AS name, '[' || ports || ']' AS data FROM (
    SELECT push_id, string_agg(8000 + size, ',' ORDER BY size) AS ports FROM
    (SELECT DISTINCT push_id, size FROM bl WHERE p_type = 'LARGE') GROUP BY push_id) JOIN pushes USING (push_id)""",
    "bl",
)


@query(
    "exposed_secrets",
    "SELECT repo, path, kind, masked, secret_sha FROM ("
    + " UNION ALL ".join(
        f"""SELECT source AS repo, 'docs/' || doc_id || '.' || lang AS path, '{kind}' AS kind,
        substr(s, 1, 4) || '***' || length(s) AS masked, sha256(s) AS secret_sha FROM
        (SELECT source, doc_id, lang, unnest(regexp_extract_all(text, '{pattern.replace("'", "''")}')) AS s FROM documents)"""
        for kind, pattern in x.SECRETS.items()
    )
    + ")",
)
def _exposed_secrets(fleet: Fleet) -> DataFrame:
    """Secrets in whole documents; only a mask and a hash leave the extractor."""
    found = fleet.text_files().select("repo", "path", F.explode(x.secrets_in(F.col("content"))).alias("s"))
    return found.select(
        "repo", "path", "s.kind", x.mask(F.col("s.found")).alias("masked"), F.sha2("s.found", 256).alias("secret_sha")
    )


@query(
    "canonical_sha",
    with_ctes(
        "SELECT repo, push_id, path, sha256(raw_data) AS sha FROM deploy JOIN pushes USING (push_id)",
        "deploy", "pushes",
    ),
)
def _canonical_sha(fleet: Fleet) -> DataFrame:
    """The rendered files have two key orders and two formats; the hash has one. Only YAML files go to Python."""
    files = fleet.files(["deploy"])
    is_yaml = F.col("path").rlike("\\.ya?ml$")
    plain = files.filter(~is_yaml).select("repo", "push_id", "path", canonical_sha(F.col("content")).alias("sha"))
    return plain.unionByName(document_shas(files.filter(is_yaml), ["repo", "push_id"]).select("repo", "push_id", "path", "sha"))


@query(
    "fingerprint_envelope",
    with_ctes(
        f"""SELECT {FACT} FROM (
        SELECT push_id, {envelope('npm-project-deps', 'npmdeps', '0.0.1')}, name, data FROM
            (SELECT push_id, name, data FROM dep) UNION ALL
        SELECT push_id, {envelope(x.TYPESCRIPT, 'tsv', '0.1.0')}, 'typescript-version', data FROM ts UNION ALL
        SELECT push_id, {envelope(x.PYTHON, 'pydep', '0.1.0')}, name, data FROM py UNION ALL
        SELECT push_id, {envelope(x.MAVEN_DIRECT, 'mvn', '0.1.0')}, name, data FROM mvnd UNION ALL
        SELECT push_id, {envelope(x.K8S, 'k8sspecs', '0.0.1')}, name, data FROM (SELECT push_id, name, data FROM specs) UNION ALL
        SELECT push_id, {envelope(x.TRAVIS)}, 'travis-scripts', data FROM travis) JOIN latest USING (push_id)""",
        "dep", "ts", "py", "mvnd", "specs", "travis", "latest",
    ),
)
def _fingerprint_envelope(fleet: Fleet) -> DataFrame:
    """Six aspects in one pass over the newest snapshots."""
    files = fleet.files(["package.json", "requirements.txt", "pom.xml", "deploy", ".travis.yml"], fleet.latest_pushes())
    return extract_facts(files, [a.NPM, a.TYPESCRIPT, a.PYTHON, a.MAVEN_DIRECT, a.K8S, a.TRAVIS])
