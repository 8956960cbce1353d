"""Row-local extractors: one file in, an array of fact items out.

Every function maps (path, content) columns to ``array<struct<type,name,data>>``
and needs nothing but its own row, so extraction is a narrow transformation:
no shuffle, no group, any number of aspects in one pass over the files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.documents import string_list, truthy
from fleetlens.functions.names import k8s_name, maven_name, npm_name_encode
from fleetlens.functions.payload import item, json_text, no_items
from fleetlens.functions.text import SPACE, extract_or_null, line_count, matches, once, unix_lines

# Names of the fact types.
NPM = "npm-project-deps"
NPM_COORDINATES = "npm-project-coordinates"
TYPESCRIPT = "typescript-version"
TSLINT = "tslint"
PYTHON = "python-direct-dep"
PARENT_POM = "maven-parent-pom"
MAVEN_DIRECT = "maven-direct-dep"
STARTER = "spring-boot-starter"
BOOT_VERSION = "spring-boot-version"
FRAMEWORKS = "csproject-targetframeworks"
TRAVIS = "travis-scripts"
K8S = "k8s-specs"
LEIN = "clojure-project-deps"
DOCKER_FROM = "docker-base-image"
DOCKER_PATH = "docker-file"
DOCKER_PORTS = "docker-ports"
LICENSE = "license"
OWNERSHIP = "code-ownership"
SECRET = "exposed-secret"
METRICS = "code-metrics"

# Fixed value: characters a POM coordinate may have (so ${...} never matches).
POM_VALUE = "[\\[\\](),a-zA-Z_.0-9-]+"

# Fixed value: what a target framework list may contain.
FRAMEWORK_PATTERN = "<TargetFrameworks?>\\s*([a-zA-Z0-9_;/.]+)\\s*</TargetFrameworks?>"

# File extension -> language of the line counts.
LANGUAGES = {
    "java": "Java",
    "ts": "TypeScript",
    "js": "JavaScript",
    "py": "Python",
    "yml": "YAML",
    "yaml": "YAML",
    "sh": "Shell",
    "ps1": "PowerShell",
    "cs": "C#",
    "clj": "Clojure",
    "go": "Go",
    "rs": "Rust",
    "rb": "Ruby",
    "kt": "Kotlin",
    "scala": "Scala",
    "swift": "Swift",
    "php": "PHP",
    "c": "C",
    "h": "C",
    "cpp": "C++",
    "tsx": "TypeScript",
    "jsx": "JavaScript",
}

# Our definitions: secret kinds and the text that gives one away.
SECRETS = {
    "aws-access-key": "AKIA[0-9A-Z]{16}",
    "private-key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github-token": "ghp_[0-9A-Za-z]{36}",
    "assigned-secret": "(?i)(?:api[_-]?key|secret|password|token)[ ]*[:=][ ]*['\"]?[0-9A-Za-z+/_.-]{8,}",
}


def npm_dependencies(content: Column) -> Column:
    """Merged dependencies and devDependencies; the dev entry wins, and of doubled keys the last one."""
    manifest = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    runtime, dev = (F.map_entries(F.coalesce(manifest[k], empty)) for k in ("dependencies", "devDependencies"))

    def last_of_each(entries):
        libs = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        last = F.transform(libs, lambda lib: F.element_at(F.filter(entries, lambda e: e["key"] == lib), -1))
        return F.when(F.size(libs) < F.size(entries), last).otherwise(entries)

    return F.transform(
        once(F.concat(runtime, dev), last_of_each),
        lambda e: item(NPM, npm_name_encode(e["key"]), F.to_json(F.array(e["key"], e["value"]))),
    )


def npm_coordinates(content: Column) -> Column:
    coords = F.from_json(content, "name string, version string")
    return F.when(
        F.try_parse_json(content).isNotNull(),
        F.array(item(NPM_COORDINATES, NPM_COORDINATES, F.to_json(coords))),
    ).otherwise(no_items())


def typescript_version(content: Column) -> Column:
    """The declared runtime and dev versions, in that order, without empty ones."""
    section = "struct<typescript:string>"
    manifest = F.from_json(content, f"dependencies {section}, devDependencies {section}")
    found = F.filter(
        F.array(manifest["dependencies"]["typescript"], manifest["devDependencies"]["typescript"]),
        lambda v: v.isNotNull() & (v != ""),
    )
    return F.when(F.size(found) > 0, F.array(item(TYPESCRIPT, TYPESCRIPT, F.to_json(found)))).otherwise(no_items())


def tslint_rules(content: Column, path: str = "rules") -> Column:
    """One fact per property of the object at ``path``; an unset value counts as ''."""
    parent, _, leaf = path.rpartition(".")
    document = F.get_json_object(content, f"$.{parent}") if parent else content
    raw = F.from_json(document, f"`{leaf}` map<string,string>")[leaf]
    typed = F.from_json(document, f"`{leaf}` map<string,variant>")[leaf]

    def rule(entry, node):
        value = (
            F.when(~truthy(node), F.lit('""'))
            .when(F.schema_of_variant(node) == "STRING", json_text(entry["value"]))
            .otherwise(entry["value"])
        )
        data = F.concat(
            F.lit('{"path":'), json_text(F.lit(path)), F.lit(',"property":'), json_text(entry["key"]),
            F.lit(',"value":'), value, F.lit("}"),
        )
        return item(TSLINT, F.concat(F.lit(f"{path}:"), entry["key"]), data)

    # both maps have the properties in text order, so they can be walked together
    pairs = F.arrays_zip(F.map_entries(raw).alias("e"), F.map_values(typed).alias("v"))
    return F.coalesce(F.transform(pairs, lambda p: rule(p["e"], p["v"])), no_items())


def python_requirements(content: Column, join_continuations: bool = True) -> Column:
    """One fact per line that starts like a package name; comments and spaces removed."""
    text = unix_lines(content)
    if join_continuations:
        text = F.regexp_replace(text, "\\\\\\n", "")
    lines = matches(text, "(?md)^[a-zA-Z0-9][A-Za-z0-9._-]*.*$")

    def requirement(line):
        uncommented = F.regexp_replace(line, f"{SPACE}+#.*$", "")
        return item(
            PYTHON,
            F.regexp_extract(line, "^[a-zA-Z0-9][A-Za-z0-9._-]*", 0),
            F.regexp_replace(uncommented, f"{SPACE}+", ""),
        )

    return F.transform(lines, requirement)


def _pom_field(block: Column, tag: str) -> Column:
    return extract_or_null(block, f"<{tag}>\\s*({POM_VALUE})\\s*</{tag}>")


def _gav(block: Column) -> Column:
    return F.struct(
        _pom_field(block, "groupId").alias("group"),
        _pom_field(block, "artifactId").alias("artifact"),
        _pom_field(block, "version").alias("version"),
    )


# A parent block whose group, artifact and version follow each other.
PARENT_BLOCK = (
    f"<parent>\\s*<groupId>\\s*{POM_VALUE}\\s*</groupId>\\s*<artifactId>\\s*{POM_VALUE}\\s*</artifactId>"
    f"\\s*<version>\\s*{POM_VALUE}\\s*</version>"
)


def maven_parent(content: Column) -> Column:
    def parent(block):
        gav = _gav(block)
        return item(PARENT_POM, maven_name(gav["group"], gav["artifact"]), F.to_json(gav))

    return F.transform(matches(content, PARENT_BLOCK), parent)


def _declared(content: Column) -> Column:
    """Dependency blocks the project itself declares: not in comments, not managed only, not those of build plugins or
    profiles, and without what they exclude."""
    own = F.regexp_replace(content, "(?s)<!--.*?-->", "")
    for block in ("dependencyManagement", "build", "profiles", "reporting", "exclusions"):
        own = F.regexp_replace(own, f"(?s)<{block}>.*?</{block}>", "")
    return F.filter(
        F.transform(matches(own, "(?s)<dependency>.*?</dependency>"), _gav),
        lambda d: d["group"].isNotNull() & d["artifact"].isNotNull(),
    )


def maven_direct(content: Column) -> Column:
    return F.transform(
        _declared(content), lambda d: item(MAVEN_DIRECT, maven_name(d["group"], d["artifact"]), F.to_json(d))
    )


def spring_boot_starters(content: Column) -> Column:
    starters = F.filter(_declared(content), lambda d: F.contains(d["artifact"], F.lit("-starter")))
    return F.transform(
        starters,
        lambda d: item(STARTER, F.concat(F.lit("starter:"), maven_name(d["group"], d["artifact"])), F.to_json(d)),
    )


def spring_boot_version(content: Column) -> Column:
    """Versions of Spring Boot named by the parent or by a declared dependency."""
    boot = "org.springframework.boot"
    parents = F.filter(F.transform(matches(content, PARENT_BLOCK), _gav), lambda d: d["group"] == boot)
    declared = F.filter(_declared(content), lambda d: (d["group"] == boot) & d["version"].isNotNull())
    versions = F.array_sort(F.array_distinct(F.transform(F.concat(parents, declared), lambda d: d["version"])))
    data = F.to_json(F.struct(F.transform(versions, lambda v: F.struct(v.alias("version"))).alias("versions")))
    return F.when(F.size(versions) > 0, F.array(item(BOOT_VERSION, BOOT_VERSION, data))).otherwise(no_items())


def lein_dependencies(content: Column) -> Column:
    """[library "version"] pairs of a Leiningen project file."""
    pairs = matches(content, '\\[\\s*[A-Za-z0-9._/-]+\\s+"[^"]+"')

    def dependency(pair):
        lib = F.regexp_extract(pair, '^\\[\\s*([^\\s"]+)', 1)
        return item(LEIN, lib, F.to_json(F.array(lib, F.regexp_extract(pair, '"([^"]+)"', 1))))

    return F.transform(pairs, dependency)


def travis_scripts(parsed: Column) -> Column:
    """The script list of a CI file; a file without scripts still is a fact."""

    def fact(document):
        scripts = once(F.try_variant_get(document, "$.script", "variant"), string_list)
        return F.when(document.isNotNull(), item(TRAVIS, TRAVIS, F.to_json(scripts)))

    return F.array_compact(F.array(once(F.try_parse_json(parsed), fact)))


def is_spec(document: Column) -> Column:
    """A variant that has apiVersion, kind and metadata.name."""
    fields = ("$.apiVersion", "$.kind", "$.metadata.name")
    first, *rest = [once(F.try_variant_get(document, f, "variant"), truthy) for f in fields]
    for condition in rest:
        first = first & condition
    return first


def spec_name(document: Column) -> Column:
    return k8s_name(
        F.try_variant_get(document, "$.kind", "string"),
        F.try_variant_get(document, "$.metadata.namespace", "string"),
        F.try_variant_get(document, "$.metadata.name", "string"),
    )


def k8s_specs(spec: Column) -> Column:
    """``spec`` is canonical JSON text; files that are no resource give nothing."""

    def fact(document):
        return F.when(is_spec(document), item(K8S, spec_name(document), spec))

    return F.array_compact(F.array(once(F.try_parse_json(spec), fact)))


def docker_from(content: Column) -> Column:
    """Base images, without references to earlier build stages."""
    lines = matches(unix_lines(content), "(?mid)^FROM[ \\t]+(?:--\\S+[ \\t]+)*(\\S+)(?:[ \\t]+AS[ \\t]+\\S+)?")
    stages = F.transform(lines, lambda x: F.lower(F.regexp_extract(x, "(?i)[ \\t]AS[ \\t]+(\\S+)$", 1)))
    images = F.transform(lines, lambda x: F.regexp_extract(x, "(?i)^FROM[ \\t]+(?:--\\S+[ \\t]+)*(\\S+)", 1))

    def image(ref):
        name = F.regexp_extract(ref, "^(.+?)(?::([^:/@]+))?(@.*)?$", 1)
        tag = F.nullif(F.regexp_extract(ref, "^(.+?)(?::([^:/@]+))?(@.*)?$", 2), F.lit(""))
        return item(DOCKER_FROM, name, F.to_json(F.struct(name.alias("image"), F.coalesce(tag, F.lit("latest")).alias("version"))))

    external = F.filter(images, lambda x: ~F.array_contains(stages, F.lower(x)))
    return F.transform(external, image)


def docker_ports(content: Column) -> Column:
    """Exposed ports of one Dockerfile as a sorted list."""
    lines = matches(unix_lines(content), "(?mid)^EXPOSE[ \\t]+([^\\n#]+)", 1)
    words = F.flatten(F.transform(lines, lambda x: matches(x, "[0-9]+(?=/|\\s|$)")))
    ports = F.array_sort(F.array_distinct(F.transform(words, lambda w: w.cast("bigint"))))
    return F.when(F.size(ports) > 0, F.array(item(DOCKER_PORTS, DOCKER_PORTS, F.to_json(ports)))).otherwise(no_items())


def dockerfile_path(path: Column) -> Column:
    return F.array(item(DOCKER_PATH, path, F.to_json(F.array(path))))


# Our definitions: licence kinds in the order they are tried.
LICENSE_TEXTS = [
    ("Apache-2.0", "(?i)apache license"),
    ("MIT", "(?i)\\bmit license|permission is hereby granted, free of charge"),
    ("GPL-3.0", "(?i)gnu general public license"),
    ("BSD", "(?i)redistribution and use in source and binary forms"),
]


def license_kind(text: Column) -> Column:
    """Kind of a licence text; 'Unknown' when no known phrase occurs."""
    kind = None
    for name, phrase in LICENSE_TEXTS:
        kind = F.when(text.rlike(phrase), F.lit(name)) if kind is None else kind.when(text.rlike(phrase), F.lit(name))
    return kind.otherwise(F.lit("Unknown"))


def licenses(content: Column) -> Column:
    kind = license_kind(content)
    return F.array(item(LICENSE, LICENSE, F.to_json(F.struct(kind.alias("classification")))))


def code_owners(content: Column) -> Column:
    """(pattern, owner) pairs of an ownership file."""
    lines = matches(unix_lines(content), "(?md)^[^#\\s]\\S*[ \\t]+\\S[^\\n]*$")

    def pairs(line):
        words = F.split(F.trim(F.regexp_replace(line, "\\s+#.*$", "")), "[ \\t]+")
        pattern = F.get(words, F.lit(0))
        owners = F.filter(F.slice(words, F.lit(2), F.size(words)), lambda w: w != "")
        return F.transform(owners, lambda o: item(OWNERSHIP, pattern, F.to_json(F.array(pattern, o))))

    return F.flatten(F.transform(lines, pairs))


def secrets_in(content: Column) -> Column:
    """array<struct<kind, found>> of every secret in a text."""

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(matches(content, pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("found")))

    return F.concat(*[of_kind(kind, pattern) for kind, pattern in SECRETS.items()])


def mask(secret: Column) -> Column:
    """First four characters and the length; the value itself is never stored."""
    return F.concat(F.substr(secret, F.lit(1), F.lit(4)), F.lit("***"), F.length(secret).cast("string"))


def exposed_secrets(path: Column, content: Column) -> Column:
    def fact(s):
        data = F.struct(path.alias("path"), mask(s["found"]).alias("masked"), F.sha2(s["found"], 256).alias("secret_sha"))
        return item(SECRET, s["kind"], F.to_json(data))

    return F.transform(secrets_in(content), fact)


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return F.try_element_at(known, F.substring_index(path, ".", -1))


def source_lines(path: Column, content: Column) -> Column:
    """Lines of one source file, named by language; summed up by the metrics. Files of no known language give none."""
    language = language_of(path)
    return F.when(language.isNotNull(), F.array(item(METRICS, language, line_count(content)))).otherwise(no_items())


def markup_matches(content: Column, pattern: str, group: int = 1) -> Column:
    """All captured values of one grammar in one file, in text order."""
    return matches(content, pattern, group)
