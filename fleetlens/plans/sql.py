"""Common table expressions of the SQL statements."""

from __future__ import annotations

from fleetlens.sources.driver import CHANGED, KNOWN_LIBRARIES, LINES_PER_UNIT

SLUG = "lower(replace(p_brand, '#', '-'))"
LIB = (
    "CASE p_brand "
    + " ".join(f"WHEN '{brand}' THEN '{lib}'" for brand, lib in KNOWN_LIBRARIES.items())
    + f" ELSE '@' || lower(p_type) || '/' || {SLUG} END"
)
_changed = ", ".join(f"CASE WHEN max((p_type = '{kind}')::INT) = 1 THEN '{path}' END" for path, kind in CHANGED)

CTE = {
    "repos": """SELECT c_custkey AS repo, n_name AS owner, r_name AS workspace FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "pushes": """SELECT o_orderkey AS push_id, o_custkey AS repo,
        CASE o_orderstatus WHEN 'F' THEN 'master' WHEN 'O' THEN 'develop' ELSE 'feature' END AS branch,
        o_orderstatus = 'F' AS is_default, o_orderdate AS ts, o_orderkey % 7 AS committer,
        o_orderpriority AS priority FROM orders""",
    "lp": f"""SELECT l_orderkey AS push_id, l_linenumber, l_quantity, p_partkey, p_type, {SLUG} AS brand, p_size,
        {LIB} AS lib FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "entry": "SELECT push_id, p_partkey % 2 = 1 AS dev, lib, max(p_size) AS size FROM lp GROUP BY ALL",
    "dep": """SELECT push_id, lib, name, version, '["' || lib || '","' || version || '"]' AS data,
        sha256('["' || lib || '","' || version || '"]') AS sha, 'npm-project-deps' AS type FROM (
        SELECT push_id, lib, replace(replace(lib, '@', ''), '/', '::') AS name,
        '^' || coalesce(max(size) FILTER (dev), max(size) FILTER (NOT dev)) || '.0.0' AS version
        FROM entry GROUP BY push_id, lib)""",
    "bl": "SELECT push_id, p_type, brand, max(p_size) AS size FROM lp GROUP BY ALL",
    "latest": """SELECT * FROM pushes WHERE is_default
        QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, push_id DESC) = 1""",
    # one row per push and part type: first brand, largest size, number of brands
    "kinds": """SELECT push_id, p_type, min(brand) AS first, max(size) AS top, count(*) AS n FROM bl GROUP BY ALL""",
    "changed": f"""SELECT push_id, list_filter([{_changed}], lambda x: x IS NOT NULL) AS files_changed
        FROM lp GROUP BY push_id""",
    "pf": "SELECT pushes.*, files_changed FROM pushes LEFT JOIN changed USING (push_id)",
    # push facts of the default branch, in push order
    "chain": """SELECT push_id, repo, ts, lead(push_id) OVER w AS next_push, lag(push_id) OVER w AS prev_push
        FROM pushes WHERE is_default WINDOW w AS (PARTITION BY repo ORDER BY ts, push_id)""",
    "depl": "SELECT latest.repo, latest.branch, latest.ts, dep.* FROM dep JOIN latest USING (push_id)",
    "target": """SELECT type, name, arg_min(data, (-n, data)) AS target_data, arg_min(sha, (-n, data)) AS target_sha
        FROM (SELECT type, name, data, sha, count(*) AS n FROM depl GROUP BY ALL) GROUP BY ALL""",
    "pom": """SELECT push_id, first, top, CASE WHEN top % 2 = 0 THEN 'org.springframework.boot'
        ELSE 'com.fleet.parents' END AS grp, CASE WHEN top % 2 = 0 THEN 'spring-boot-starter-parent'
        ELSE first || '-parent' END AS artifact, top || '.0.0' AS version FROM kinds WHERE p_type = 'PROMO'""",
    "parent": """SELECT push_id, 'maven-parent-pom' AS type, path, grp, artifact, version, grp || ':' || artifact AS name,
        '{"group":"' || grp || '","artifact":"' || artifact || '","version":"' || version || '"}' AS data,
        sha256('{"group":"' || grp || '","artifact":"' || artifact || '","version":"' || version || '"}') AS sha FROM (
        SELECT push_id, 'pom.xml' AS path, grp, artifact, version FROM pom UNION ALL
        SELECT push_id, 'module/pom.xml', 'com.fleet', 'root-' || first, '1.' || top FROM pom)""",
    "mvn": """SELECT push_id, 'com.' || brand AS grp, brand || CASE WHEN size > 25 THEN '-starter' ELSE '-core' END
        AS artifact, CASE WHEN size % 3 <> 0 THEN '1.' || size END AS version FROM bl WHERE p_type = 'PROMO'""",
    "mvnd": """SELECT push_id, grp || ':' || artifact AS name, artifact, '{"group":"' || grp || '","artifact":"' || artifact
        || coalesce('","version":"' || version, '') || '"}' AS data FROM mvn""",
    "deploy": """SELECT push_id, first, top, CASE WHEN push_id % 2 = 0 THEN 'deploy.json' ELSE 'deploy.yml' END AS path,
        '{"apiVersion":"apps/v1","kind":"Deployment","metadata":{"labels":{"app":"' || first || '"},"name":"' || first
        || '","namespace":"fleet"},"spec":{"replicas":' || top || '}}' AS data,
        '{"apiVersion":"apps/v1","kind":"Deployment","metadata":{"labels":{"app":"' || first
        || '","app.kubernetes.io/managed-by":"someone"},"name":"' || first || '","namespace":"fleet"},"spec":{"replicas":'
        || top || '}}' AS raw_data FROM kinds WHERE p_type = 'LARGE'""",
    "specs": "SELECT push_id, path, 'k8s-specs' AS type, 'Deployment::fleet::' || first AS name, data, sha256(data) AS sha FROM deploy",
    "travis": """SELECT push_id, '["' || string_agg('make ' || brand || '-' || size, '","' ORDER BY brand) || '"]' AS data,
        string_agg('make ' || brand || '-' || size, ',' ORDER BY brand) AS scripts,
        string_agg(brand, ',' ORDER BY brand) AS services, count(*) AS n FROM bl WHERE p_type = 'MEDIUM' GROUP BY push_id""",
    "ts": """SELECT push_id, '["' || concat_ws('","', '^' || (max(size) FILTER (NOT dev)) || '.0.0',
        '^' || (max(size) FILTER (dev)) || '.0.0') || '"]' AS data FROM entry WHERE lib = 'typescript' GROUP BY push_id""",
    "py": "SELECT push_id, brand AS name, brand || '==' || size AS data FROM bl WHERE p_type = 'SMALL'",
    "loc": f"""SELECT push_id, CASE p_type WHEN 'PROMO' THEN 'Java' WHEN 'ECONOMY' THEN 'TypeScript' WHEN 'SMALL' THEN 'Python'
        WHEN 'MEDIUM' THEN 'YAML' WHEN 'LARGE' THEN 'Shell' ELSE 'PowerShell' END AS language,
        sum(l_quantity::BIGINT * {LINES_PER_UNIT})::BIGINT AS lines FROM lp GROUP BY ALL""",
    "committers": """SELECT repo, count(DISTINCT committer) AS committers FROM (SELECT * FROM pushes
        QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, push_id DESC) <= 30) GROUP BY repo""",
    "git": """SELECT repo, count(DISTINCT branch) AS branches,
        date_diff('day', max(ts), (SELECT max(ts) FROM pushes)) AS days FROM pushes GROUP BY repo""",
    # everything taggers and scorers need, per repository
    "prof": """SELECT l.repo, l.push_id, l.priority AS p, coalesce(f.has, []) AS has, coalesce(f.libs, []) AS libs,
        coalesce(f.promo_top, 1) AS promo_top, coalesce(f.readme, 0) AS readme, coalesce(c.lines, 0) AS lines,
        coalesce(c.languages, 0) AS languages, coalesce(c.yaml, 0) AS yaml, coalesce(c.powershell, 0) AS powershell,
        coalesce(c.shell, 0) AS shell, g.branches, g.days, m.committers
        FROM latest l JOIN git g USING (repo) JOIN committers m USING (repo)
        LEFT JOIN (SELECT push_id, list(DISTINCT p_type) AS has, list(DISTINCT lib) AS libs,
            max(p_size) FILTER (p_type = 'PROMO') AS promo_top,
            (3 + length(min(brand) FILTER (p_type = 'STANDARD')) + 6 * max(p_size) FILTER (p_type = 'STANDARD')) AS readme
            FROM lp GROUP BY push_id) f USING (push_id)
        LEFT JOIN (SELECT push_id, sum(lines)::BIGINT AS lines, count(*) AS languages, max(lines) FILTER (language = 'YAML') AS yaml,
            max(lines) FILTER (language = 'PowerShell') AS powershell, max(lines) FILTER (language = 'Shell') AS shell
            FROM loc GROUP BY push_id) c USING (push_id)""",
    "ev": """SELECT event_id, user_id AS repo, ts, CASE event_type WHEN 'purchase' THEN 'build' WHEN 'error' THEN 'build-failed'
        WHEN 'signup' THEN 'tag-confirmed' ELSE 'push' END AS kind, value FROM events""",
}

NEEDS = {
    "entry": ["lp"], "dep": ["entry"], "bl": ["lp"], "latest": ["pushes"], "kinds": ["bl"], "changed": ["lp"],
    "pf": ["pushes", "changed"], "chain": ["pushes"], "depl": ["dep", "latest"], "target": ["depl"], "pom": ["kinds"],
    "parent": ["pom"], "mvn": ["bl"], "mvnd": ["mvn"], "deploy": ["kinds"], "specs": ["deploy"], "travis": ["bl"],
    "ts": ["entry"], "py": ["bl"], "loc": ["lp"], "committers": ["pushes"], "git": ["pushes"],
    "prof": ["latest", "git", "committers", "lp", "loc"],
}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named expressions and whatever they need."""
    tables = {n: CTE[n] for n in _ordered(list(names))} | (extra or {})
    heads = ",\n".join(f"{name} AS ({text})" for name, text in tables.items())
    return f"WITH {heads}\n{body}" if tables else body


def envelope(type_: str, abbreviation: str | None = None, version: str | None = None) -> str:
    """Constant columns of a fact."""
    quote = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'"
    return f"'{type_}' AS type, {quote(abbreviation)} AS abbreviation, {quote(version)} AS version"
