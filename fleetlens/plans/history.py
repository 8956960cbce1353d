"""Queries over git history, delivery events, names and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.display import display_name, display_value
from fleetlens.functions.names import k8s_display_name, k8s_name, npm_name_decode, npm_name_encode
from fleetlens.operators import aspects as a
from fleetlens.operators import delivery
from fleetlens.operators.aspects import DISPLAY_NAMES, extract_facts, fact_items, without_hidden
from fleetlens.operators.diff import fingerprint_diff
from fleetlens.operators.presence import classify, file_match, target_frameworks
from fleetlens.plans.registry import query
from fleetlens.plans.sql import envelope, with_ctes
from fleetlens.sources.driver import Fleet, library, slug

SUGGESTED = ("frivolous", "You people are silly")

# --- git and delivery metrics ---------------------------------------------


@query("branch_count", with_ctes("SELECT repo, branches FROM git", "git"))
def _branch_count(fleet: Fleet) -> DataFrame:
    return delivery.branch_count(fleet.pushes())


@query(
    "git_recency",
    with_ctes("SELECT repo, strftime(max(ts), '%Y-%m-%d') AS last_day, any_value(days) AS days FROM pushes JOIN git USING (repo) GROUP BY repo", "git"),
)
def _git_recency(fleet: Fleet) -> DataFrame:
    recency = delivery.git_recency(fleet.pushes(), fleet.as_of())
    return recency.select("repo", F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"), "days")


@query("active_committers", with_ctes("SELECT repo, committers FROM committers", "committers"))
def _active_committers(fleet: Fleet) -> DataFrame:
    return delivery.active_committers(fleet.pushes())


@query(
    "code_metrics",
    """WITH d AS (SELECT source AS repo, lang AS language, length(text) - length(replace(text, chr(10), ''))
    + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines FROM documents)
    SELECT repo, language, grouping(repo, language)::BIGINT AS level, count(*) AS files, sum(lines)::BIGINT AS lines
    FROM d GROUP BY ROLLUP (repo, language)""",
)
def _code_metrics(fleet: Fleet) -> DataFrame:
    return delivery.code_metrics(fleet.text_files())


@query(
    "build_time",
    with_ctes(
        """SELECT repo, count(*) AS builds, floor(sum(value::DECIMAL(18, 6))::DOUBLE / count(*) * 1000000 + 0.5) / 1000000 AS mean_seconds,
        floor(median(value) * 1000000 + 0.5) / 1000000 AS median_seconds,
        max(value) AS max_seconds FROM ev WHERE kind = 'build' GROUP BY repo""",
        "ev",
    ),
)
def _build_time(fleet: Fleet) -> DataFrame:
    return delivery.build_time(fleet.delivery_events())


@query(
    "build_time_moving",
    with_ctes(
        """SELECT event_id, repo, value, round(avg(value) OVER (PARTITION BY repo ORDER BY ts, event_id
        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_mean FROM ev WHERE kind = 'build'""",
        "ev",
    ),
)
def _build_time_moving(fleet: Fleet) -> DataFrame:
    return delivery.build_time_moving(fleet.delivery_events())


@query(
    "suggest_tag",
    with_ctes(
        f"""SELECT repo, push_id, {envelope('suggest-tag')}, 'suggestTag' AS name,
        '{{"tag":"{SUGGESTED[0]}","reason":"{SUGGESTED[1]}"}}' AS data,
        sha256('{{"tag":"{SUGGESTED[0]}","reason":"{SUGGESTED[1]}"}}') AS sha FROM pushes""",
        "pushes",
    ),
)
def _suggest_tag(fleet: Fleet) -> DataFrame:
    return delivery.suggest_tag(fleet.pushes(), *SUGGESTED, test=F.lit(True))


@query(
    "tag_suggestion_feed",
    with_ctes(
        """SELECT owner, c.repo, 'master' AS branch, c.push_id, 'https://git.example.org/' || owner || '/' || c.repo AS url,
        'maven-change' AS tag, 'the POM changed' AS reason FROM chain c JOIN repos USING (repo)
        LEFT JOIN changed n ON n.push_id = c.push_id LEFT JOIN changed o ON o.push_id = c.prev_push
        WHERE c.prev_push IS NOT NULL AND coalesce(list_contains(n.files_changed, 'pom.xml'), false)
        AND NOT coalesce(list_contains(o.files_changed, 'pom.xml'), false)""",
        "chain", "repos", "changed",
    ),
)
def _tag_suggestion_feed(fleet: Fleet) -> DataFrame:
    pushes = fleet.pushes_with_files().filter("is_default")
    facts = delivery.suggest_tag(pushes, "maven-change", "the POM changed", F.array_contains("files_changed", "pom.xml"))
    history = fleet.pushes().filter("is_default")
    return delivery.tag_suggestion_feed(fingerprint_diff(facts, history), history, fleet.repos().drop("workspace"))


@query(
    "confirmed_tags",
    with_ctes(
        f"""SELECT repo, event_id AS push_id, {envelope('confirmed-tag')}, 'level-' || (value::BIGINT // 10) AS name,
        '{{"tag":"level-' || (value::BIGINT // 10) || '","reason":"confirmed by a human"}}' AS data,
        sha256('{{"tag":"level-' || (value::BIGINT // 10) || '","reason":"confirmed by a human"}}') AS sha
        FROM (SELECT repo, event_id, floor(value) AS value FROM ev WHERE kind = 'tag-confirmed')""",
        "ev",
    ),
)
def _confirmed_tags(fleet: Fleet) -> DataFrame:
    confirmations = fleet.delivery_events().filter("kind = 'tag-confirmed'").select(
        "repo",
        F.col("event_id").alias("push_id"),
        F.concat(F.lit("level-"), F.expr("cast(floor(value) as bigint) div 10").cast("string")).alias("tag"),
        F.lit("confirmed by a human").alias("reason"),
    )
    return delivery.confirmed_tags(confirmations)


# --- names and display ---------------------------------------------------------

PART_LIBS = "SELECT DISTINCT lib, replace(replace(lib, '@', ''), '/', '::') AS name FROM lp"


def _libraries(fleet: Fleet) -> DataFrame:
    return fleet.part_lines().select(library(F.col("p_type"), F.col("p_brand")).alias("lib")).distinct()


@query("npm_name_encode", with_ctes(f"SELECT lib, name FROM ({PART_LIBS})", "lp"))
def _npm_name_encode(fleet: Fleet) -> DataFrame:
    return _libraries(fleet).select("lib", npm_name_encode(F.col("lib")).alias("name"))


@query("npm_name_decode", with_ctes(f"SELECT name, lib FROM ({PART_LIBS}) UNION ALL SELECT '::' || name, NULL FROM ({PART_LIBS})", "lp"))
def _npm_name_decode(fleet: Fleet) -> DataFrame:
    """Decoding gives the library back; a name that starts with a colon is no name."""
    good = _libraries(fleet).select(npm_name_encode(F.col("lib")).alias("name"))
    names = good.unionByName(good.select(F.concat(F.lit("::"), "name").alias("name")))
    return names.select("name", npm_name_decode(F.col("name")).alias("lib"))


def _objects(fleet: Fleet) -> DataFrame:
    """(kind, namespace, object): brands of size classes as resource coordinates."""
    return fleet.table("part").select(
        F.initcap("p_type").alias("kind"),
        F.when(F.col("p_size") > 25, slug(F.col("p_brand"))).otherwise(F.when(F.col("p_size") > 10, "")).alias("namespace"),
        F.col("p_name").alias("object"),
    ).distinct()


OBJECTS = """SELECT DISTINCT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind, p_name AS object,
    CASE WHEN p_size > 25 THEN lower(replace(p_brand, '#', '-')) WHEN p_size > 10 THEN '' END AS namespace FROM part"""


@query(
    "k8s_name",
    f"""SELECT kind, namespace, object, kind || '::' || CASE WHEN coalesce(namespace, '') = '' THEN ''
    ELSE namespace || '::' END || object AS name FROM ({OBJECTS})""",
)
def _k8s_name(fleet: Fleet) -> DataFrame:
    return _objects(fleet).withColumn("name", k8s_name(F.col("kind"), F.col("namespace"), F.col("object")))


@query(
    "k8s_display_name",
    f"""SELECT kind || '::' || namespace || '::' || object AS name, kind || '/' || namespace || '/' || object AS display
    FROM ({OBJECTS}) WHERE namespace <> ''""",
)
def _k8s_display_name(fleet: Fleet) -> DataFrame:
    name = k8s_name(F.col("kind"), F.col("namespace"), F.col("object"))
    return _objects(fleet).filter("namespace <> ''").select(name.alias("name"), k8s_display_name(name).alias("display"))


_SHOWN = with_ctes(
    """SELECT repo, type, name, display FROM (
    SELECT push_id, 'npm-project-deps' AS type, name, version AS display FROM dep UNION ALL
    SELECT push_id, 'typescript-version', 'typescript-version', array_to_string(from_json(data, '["VARCHAR"]'), ',') FROM ts UNION ALL
    SELECT push_id, 'travis-scripts', 'travis-scripts', scripts FROM travis UNION ALL
    SELECT push_id, 'python-direct-dep', name, substr(data, length(name) + 1) FROM py UNION ALL
    SELECT push_id, 'maven-parent-pom', name, version FROM parent UNION ALL
    SELECT push_id, 'maven-direct-dep', grp || ':' || artifact, version FROM mvn UNION ALL
    SELECT push_id, 'spring-boot-starter', 'starter:' || grp || ':' || artifact, coalesce(version, 'inherited') FROM mvn
        WHERE contains(artifact, '-starter') UNION ALL
    SELECT push_id, 'spring-boot-version', 'spring-boot-version', version FROM pom WHERE grp = 'org.springframework.boot' UNION ALL
    SELECT push_id, 'csproject-targetframeworks', 'csproject-targetframeworks', string_agg('net' || size, ';' ORDER BY size)
        FROM (SELECT DISTINCT push_id, size FROM bl WHERE p_type = 'ECONOMY') GROUP BY push_id UNION ALL
    SELECT push_id, 'k8s-specs', name, replace(name, '::', '/') FROM specs) JOIN latest USING (push_id)""",
    "dep", "ts", "travis", "py", "parent", "mvn", "pom", "bl", "specs", "latest",
)

SHOWN_KINDS = ["package.json", "requirements.txt", "pom.xml", "module/pom.xml", "App.csproj", "deploy", ".travis.yml"]
SHOWN_ASPECTS = [
    "NPM", "TYPESCRIPT", "TRAVIS", "PYTHON", "PARENT_POM", "MAVEN_DIRECT", "STARTER", "BOOT_VERSION", "K8S",
]


@query("display_value", _SHOWN)
def _display_value(fleet: Fleet) -> DataFrame:
    latest = fleet.latest_pushes()
    facts = fact_items(fleet.files(SHOWN_KINDS, latest), [getattr(a, n) for n in SHOWN_ASPECTS])
    frameworks = target_frameworks(fleet.files(["App.csproj"], latest)).select(*facts.columns)
    shown = display_value(F.col("type"), F.col("name"), F.col("data")).alias("display")
    return facts.unionByName(frameworks).select("repo", "type", "name", shown)


@query(
    "display_name",
    with_ctes(
        """SELECT DISTINCT type, name, display FROM (
        SELECT push_id, 'npm-project-deps' AS type, name, lib AS display FROM dep UNION ALL
        SELECT push_id, 'typescript-version', 'typescript-version', 'TypeScript version' FROM ts UNION ALL
        SELECT push_id, 'spring-boot-version', 'spring-boot-version', 'Spring Boot version' FROM pom
            WHERE grp = 'org.springframework.boot' UNION ALL
        SELECT push_id, 'stack', 'stack', 'Technology stack' FROM pushes UNION ALL
        SELECT push_id, 'javaBuild', 'javaBuild', 'Java build tool' FROM pushes LEFT JOIN pom USING (push_id)
            WHERE priority = '5-LOW' OR pom.first IS NOT NULL UNION ALL
        SELECT push_id, 'ci', 'ci', 'CI tool' FROM pushes WHERE priority IN ('2-HIGH', '3-MEDIUM') UNION ALL
        SELECT push_id, 'maven-parent-pom', name, name FROM parent UNION ALL
        SELECT push_id, 'k8s-specs', name, replace(name, '::', '/') FROM specs) JOIN latest USING (push_id)""",
        "dep", "ts", "pom", "parent", "specs", "latest",
    ),
)
def _display_name(fleet: Fleet) -> DataFrame:
    latest = fleet.latest_pushes()
    files = fleet.files(["package.json", "pom.xml", "module/pom.xml", "deploy", "priority"], latest)
    facts = fact_items(files, [a.NPM, a.TYPESCRIPT, a.BOOT_VERSION, a.PARENT_POM, a.K8S])
    named = facts.select("type", "name").unionByName(classify(files).select("type", "name")).distinct()
    return named.select("type", "name", display_name(F.col("type"), F.col("name")).alias("display"))


@query(
    "hidden_aspects",
    with_ctes(
        """SELECT type, count(*) AS facts FROM (SELECT 'azure-pipelines' AS type FROM latest UNION ALL
        SELECT 'readme' FROM latest UNION ALL SELECT 'license' FROM latest WHERE priority IN ('1-URGENT', '2-HIGH') UNION ALL
        SELECT 'stack' FROM latest UNION ALL SELECT 'javaBuild' FROM latest WHERE priority = '5-LOW') GROUP BY type""",
        "latest",
    ),
)
def _hidden_aspects(fleet: Fleet) -> DataFrame:
    """Facts a report shows: glob facts of build files and CI facts are dropped."""
    files = fleet.files(["package.json", "priority"], fleet.latest_pushes())
    facts = file_match(files).unionByName(extract_facts(files, [a.LICENSE])).unionByName(classify(files))
    return without_hidden(facts).groupBy("type").agg(F.count("*").alias("facts"))
