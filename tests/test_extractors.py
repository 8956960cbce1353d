"""Package manifests, POMs, project files and other text files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.display import display_value, without_first
from fleetlens.functions.names import npm_name_decode, npm_name_encode
from fleetlens.functions.text import ancestors, line_count
from fleetlens.operators import aspects as a
from fleetlens.operators import extractors as x
from fleetlens.operators import presence
from fleetlens.operators.aspects import Aspect, extract_facts, rejects
from fleetlens.operators.remediate import npm_remediation, parent_pom_remediation
from fleetlens.sources.files import files_by_glob, glob_to_regex, path_matches, read_checkouts


def facts(df, *aspects):
    return sorted((r.repo, r.name, r.data) for r in extract_facts(df, list(aspects)).collect())


REQUIREMENTS = """# pinned by the data team
##  two marks
# celery
flask
flask-login
attrs23
pendulum == 2.1.2   # last one that our code takes
tornado != 6.0      # broken
Geo-Tools ~= \\
    0.7             # joined with the line above
-r constraints/base.txt
./wheels/scikit-0.24-py3-none-any.whl
http://packages.example.org/wheels/fleet_tools-1.0.whl
plainword
WinOnly; platform_system == 'Windows'
"""


@pytest.mark.parametrize("text", [REQUIREMENTS, REQUIREMENTS.replace("\n", "\r\n"), REQUIREMENTS.replace("\\\n", "")])
def test_python_requirements(files, text):
    found = {n: d for _, n, d in facts(files(p=[("requirements.txt", text), ("sub/requirements.txt", "no")]), a.PYTHON)}
    assert found == {
        "flask": "flask",
        "flask-login": "flask-login",
        "attrs23": "attrs23",
        "pendulum": "pendulum==2.1.2",
        "tornado": "tornado!=6.0",
        "Geo-Tools": "Geo-Tools~=0.7",
        "http": "http://packages.example.org/wheels/fleet_tools-1.0.whl",
        "plainword": "plainword",
        "WinOnly": "WinOnly;platform_system=='Windows'",
    }


def test_python_without_joined_lines(files):
    plain = Aspect(x.PYTHON, "", "requirements.txt", lambda c: x.python_requirements(c, join_continuations=False))
    found = {n: d for _, n, d in facts(files(p=[("requirements.txt", REQUIREMENTS)]), plain)}
    assert found["Geo-Tools"] == "Geo-Tools~=\\"


def test_doubled_keys_of_a_manifest(files):
    df = files(a=[("package.json", '{"dependencies":{"a":"1","a":"2","b":"3"},"devDependencies":{"b":"4","b":"5"}}')])
    assert [d for _, _, d in facts(df, a.NPM)] == ['["a","2"]', '["b","5"]']


def test_only_own_maven_dependencies_are_declared(files):
    def dep(name):
        return f"<dependency><groupId>g</groupId><artifactId>{name}</artifactId><version>1</version></dependency>"

    inner = dep("own").replace("</dependency>", "<exclusions><exclusion><groupId>g</groupId></exclusion></exclusions></dependency>")
    pom = (
        f"<project><!-- {dep('off')} --><dependencies>{inner}</dependencies><build><plugins><plugin>{dep('plugin')}</plugin></plugins>"
        f"</build><profiles>{dep('profile')}</profiles><dependencyManagement>{dep('managed')}</dependencyManagement></project>"
    )
    assert [n for _, n, _ in facts(files(p=[("pom.xml", pom)]), a.MAVEN_DIRECT)] == ["g:own"]


def test_files_anywhere_are_read(files):
    df = files(p=[("docker/Dockerfile", "FROM base:1\nEXPOSE 80\n"), ("conf/app.yml", "token: abcdefgh12\n"), ("src/x.unknown", "a\n")])
    assert [n for _, n, _ in facts(df, a.DOCKER_FROM)] and [n for _, n, _ in facts(df, a.DOCKER_PORTS)]
    assert [n for _, n, _ in facts(df, a.SECRETS)] == ["assigned-secret"]
    assert facts(df, a.METRICS) == []


def test_files_without_a_project_belong_to_the_root(files):
    df = files(p=[("app/package.json", "{}"), ("app/x.ts", ""), ("other/y.ts", "")])
    found = {r.path: r.project for r in presence.assign_projects(df, presence.virtual_projects(df)).collect()}
    assert found == {"app/package.json": "app", "app/x.ts": "app", "other/y.ts": ""}


def test_remediation_leaves_scripts_alone(spark):
    from fleetlens.operators.remediate import set_library_version

    text = '{"scripts":{"mocha":"mocha -r ts"},"dependencies":{"a":"1","mocha":"^8"},"devDependencies":{"mocha":"^7"}}'
    row = spark.createDataFrame([(text,)], "c string").select(set_library_version(F.col("c"), F.lit("mocha"), F.lit("^9")).alias("r")).first()
    assert json.loads(row.r) == {"scripts": {"mocha": "mocha -r ts"}, "dependencies": {"a": "1", "mocha": "^9"}, "devDependencies": {"mocha": "^9"}}


def test_npm_dependencies(files):
    manifest = {"dependencies": {"lodash": "1", "@types/node": "2", "ü": "3"}, "devDependencies": {"lodash": "4"}}
    df = files(
        a=[("package.json", json.dumps(manifest, ensure_ascii=False))],
        b=[("package.json", '{"name":"only"}')],
        c=[("package.json", "{broken")],
        d=[("sub/package.json", json.dumps(manifest))],
    )
    assert facts(df, a.NPM) == [
        ("a", "lodash", '["lodash","4"]'),
        ("a", "types::node", '["@types/node","2"]'),
        ("a", "ü", '["ü","3"]'),
    ]
    sha = {r.name: r.sha for r in extract_facts(df, [a.NPM]).collect()}
    assert sha["lodash"] == hashlib.sha256(b'["lodash","4"]').hexdigest()
    assert [(r.repo, r.aspect) for r in rejects(df).collect()] == [("c", "npm-project-deps")]
    assert facts(df, a.NPM_COORDINATES)[1] == ("b", "npm-project-coordinates", '{"name":"only"}')


def test_typescript_version(files):
    df = files(
        dep=[("package.json", '{"dependencies":{"typescript":"1"}}')],
        dev=[("package.json", '{"devDependencies":{"typescript":"2"}}')],
        both=[("package.json", '{"dependencies":{"typescript":"1"},"devDependencies":{"typescript":"2"}}')],
        none=[("package.json", '{"dependencies":{"typescript":""}}')],
        bad=[("package.json", "nope")],
    )
    assert {(r, d) for r, _, d in facts(df, a.TYPESCRIPT)} == {("dep", '["1"]'), ("dev", '["2"]'), ("both", '["1","2"]')}


def test_tslint_values(files):
    rules = {"f": False, "z": 0, "e": "", "n": None, "t": True, "s": "false", "l": [True, {"b": 1, "a": 2}]}
    df = files(p=[("tslint.json", json.dumps({"rules": rules}))], q=[("tslint.json", "{}")])
    found = {n: json.loads(d)["value"] for _, n, d in facts(df, a.TSLINT)}
    assert found == {
        "rules:f": "", "rules:z": "", "rules:e": "", "rules:n": "", "rules:t": True, "rules:s": "false",
        "rules:l": [True, {"b": 1, "a": 2}],
    }
    assert '{"path":"rules","property":"l","value":[true,{"b":1,"a":2}]}' in {d for _, _, d in facts(df, a.TSLINT)}


def parent(group, artifact, version):
    return f"<parent>\n <groupId> {group} </groupId>\n <artifactId>{artifact}</artifactId><version>{version}</version></parent>"


def test_parent_pom(files):
    swapped = "<parent><artifactId>a</artifactId><groupId>g</groupId><version>1</version></parent>"
    df = files(
        p=[("pom.xml", parent("g", "a", "1.0")), ("m/pom.xml", parent("g", "b", "[1,2)"))],
        q=[("pom.xml", parent("g", "a", "${revision}")), ("x/pom.xml", swapped), ("notpom.xml", parent("g", "a", "1"))],
    )
    assert facts(df, a.PARENT_POM) == [
        ("p", "g:a", '{"group":"g","artifact":"a","version":"1.0"}'),
        ("p", "g:b", '{"group":"g","artifact":"b","version":"[1,2)"}'),
    ]


def test_declared_dependencies(files):
    pom = """<project><dependencyManagement><dependencies><dependency><groupId>no</groupId><artifactId>no</artifactId>
    </dependency></dependencies></dependencyManagement><dependencies>
    <dependency><groupId>org.springframework.boot</groupId><artifactId>x-starter-web</artifactId><version>2.1</version></dependency>
    <dependency><groupId>g</groupId><artifactId>plain</artifactId></dependency></dependencies></project>"""
    df = files(p=[("pom.xml", pom)], q=[("pom.xml", "<project/>")])
    assert [n for _, n, _ in facts(df, a.MAVEN_DIRECT)] == ["g:plain", "org.springframework.boot:x-starter-web"]
    assert [n for _, n, _ in facts(df, a.STARTER)] == ["starter:org.springframework.boot:x-starter-web"]
    assert facts(df, a.BOOT_VERSION) == [("p", "spring-boot-version", '{"versions":[{"version":"2.1"}]}')]


def test_target_frameworks(files):
    tag = "<TargetFramework>{}</TargetFramework>"
    df = files(
        p=[("b.csproj", tag.format("net5")), ("a.csproj", "<TargetFrameworks> n1;n2 </TargetFrameworks>")],
        q=[("a.csproj", tag.format("net5.0-windows")), ("sub/c.csproj", tag.format("net6"))],
    )
    (row,) = presence.target_frameworks(df).collect()
    assert json.loads(row.data)["matches"] == [
        {"path": "a.csproj", "matchValue": "n1;n2"},
        {"path": "b.csproj", "matchValue": "net5"},
    ]


def test_dockerfile(files):
    text = "# FROM no\nFROM node:10 AS build\nfrom build\nFROM --platform=x reg:5000/img@sha256:1\nEXPOSE 80 443/tcp\nexpose 8080\n"
    df = files(p=[("Dockerfile", text), ("sub/Dockerfile", "FROM scratch")])
    assert [(n, json.loads(d)["version"]) for _, n, d in facts(df, a.DOCKER_FROM)] == [
        ("node", "10"), ("reg:5000/img", "latest"), ("scratch", "latest"),
    ]
    assert [d for _, _, d in facts(df, a.DOCKER_PORTS)] == ["[80,443,8080]"]
    assert [n for _, n, _ in facts(df, a.DOCKER_PATH)] == ["Dockerfile", "sub/Dockerfile"]


def test_secrets_are_masked(files):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    df = files(p=[("config.env", f"x={key}\n"), ("deep/b.env", "password: hunter2hunter2")])
    rows = facts(df, a.SECRETS)
    assert {n for _, n, _ in rows} == {"aws-access-key", "assigned-secret"}
    assert not any(key in d or "hunter2" in d for _, _, d in rows)


def test_classification(files):
    df = files(
        jvm=[("pom.xml", ""), ("build.gradle", "")],
        py=[("setup.py", ""), ("lib/x.py", "")],
        deep=[("lib/x.py", ""), ("sub/pom.xml", "")],
        all=[("package.json", ""), ("requirements.txt", ""), ("template.yml", ""), ("Jenkinsfile", ""), ("pipeline.yml", "")],
    )
    found = {(r.repo, r.type): json.loads(r.data) for r in presence.classify(df).collect()}
    assert found["jvm", "stack"] == {"tags": ["jvm"], "reasons": ["has Maven POM", "has build.gradle"]}
    assert found["jvm", "javaBuild"]["tags"] == ["gradle", "maven"]
    assert found["py", "stack"]["reasons"] == ["has Python files in root"]
    assert found["all", "stack"]["tags"] == ["aws", "lambda", "node", "python"]
    assert found["all", "ci"]["tags"] == ["concourse", "jenkins"]
    assert not any(repo == "deep" for repo, _ in found)


def test_file_match_without_matches(files):
    df = files(a=[("README.md", ""), ("b.csproj", ""), ("a.csproj", "")], b=[("x", "")])
    found = {(r.repo, r.type): [m["path"] for m in json.loads(r.data)["matches"]] for r in presence.file_match(df).collect()}
    assert found["a", "csproject"] == ["a.csproj", "b.csproj"] and found["a", "readme"] == ["README.md"]
    assert found["b", "csproject"] == [] and len(found) == 8


def test_projects_by_longest_prefix(files):
    df = files(a=[("package.json", ""), ("svc/a/pom.xml", ""), ("svc/a/src/X.java", ""), ("svc/ab/Y.java", ""), ("z", "")])
    assigned = {r.path: r.project for r in presence.assign_projects(df, presence.virtual_projects(df)).collect()}
    assert assigned["svc/a/src/X.java"] == "svc/a" and assigned["svc/ab/Y.java"] == "" and assigned["z"] == ""


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("*.py", ["a.py"], ["d/a.py", "apy"]),
        ("**/pom.xml", ["pom.xml", "a/b/pom.xml"], ["xpom.xml", "a/xpom.xml"]),
        ("*.@(json|yaml|yml)", ["a.json", "b.yml"], ["c/a.json", "a.jsonx"]),
        ("src/**", ["src/a", "src/b/c"], ["xsrc/a", "src"]),
        ("**/*.env", ["a.env", "b/c.env"], ["a.envx"]),
        ("{a,b}?.txt", ["a1.txt", "b2.txt"], ["a.txt", "c1.txt"]),
        (".snyk", [".snyk"], ["xsnyk"]),
    ],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert {r.path for r in files_by_glob(df, glob).collect()} == set(yes)
    by_pattern = df.filter(F.col("path").rlike(glob_to_regex(glob)))
    assert {r.path for r in by_pattern.collect()} == set(yes)
    assert path_matches is not None


def test_npm_names(spark):
    df = spark.createDataFrame([("lodash",), ("@types/lodash",), ("@a/b/c@d",), ("",)], "lib string")
    rows = df.select("lib", npm_name_encode(F.col("lib")).alias("n")).withColumn("back", npm_name_decode(F.col("n"))).collect()
    assert [(r.n, r.back) for r in rows] == [
        ("lodash", "lodash"), ("types::lodash", "@types/lodash"), ("a::b/c@d", "@a/b/c@d"), ("", None),
    ]


def test_text_helpers(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n\n",)], "t string")
    assert [r[0] for r in df.select(line_count(F.col("t"))).collect()] == [0, 1, 1, 2, 2]
    one = spark.createDataFrame([("a/b/c.txt", "x.b.x", "x")], "p string, t string, s string")
    row = one.select(ancestors(F.col("p")).alias("d"), without_first(F.col("t"), F.col("s")).alias("w")).first()
    assert row.d == ["", "a", "a/b"] and row.w == ".b.x"


def test_display_of_missing_versions(spark):
    rows = [
        ("spring-boot-starter", "s", '{"group":"g","artifact":"a"}', "inherited"),
        ("maven-deps", "m", '{"group":"g"}', "no version"),
        ("csproject-targetframeworks", "c", '{"matches":[]}', "None"),
        ("confirmed-tag", "t", '{"tag":"t","reason":"r"}', "t because r"),
        ("suggest-tag", "t", '{"tag":"t","reason":"r"}', "t"),
        ("typescript-version", "t", '["1","2"]', "1,2"),
    ]
    df = spark.createDataFrame(rows, "type string, name string, data string, want string")
    got = df.select(display_value(F.col("type"), F.col("name"), F.col("data")).alias("v"), "want").collect()
    assert [r.v for r in got] == [r.want for r in got]


def test_npm_remediation_is_exact(spark, files):
    text = '{"dependencies": {"a.b": "1", "axb": "2"}, "devDependencies": {"a.b":"3", "q$": "4"}}'
    edits = [("p", 1, x.NPM, '["a.b","$9\\\\"]'), ("p", 1, x.NPM, '["q$","5"]')]
    deviations = spark.createDataFrame(edits, "repo string, push_id bigint, type string, target_data string")
    (row,) = npm_remediation(files(p=[("package.json", text)], q=[("package.json", text)]), deviations).collect()
    assert row.edits == 2
    assert row.content == '{"dependencies": {"a.b": "$9\\", "axb": "2"}, "devDependencies": {"a.b": "$9\\", "q$": "5"}}'


def test_parent_remediation_changes_the_first_block_only(spark, files):
    text = parent("x", "a", "1") + parent("g", "a", "1") + parent("g", "a", "2")
    target = [("p", 1, "pom.xml", x.PARENT_POM, '{"group":"g","artifact":"a","version":"9"}')]
    deviations = spark.createDataFrame(target, "repo string, push_id bigint, path string, type string, target_data string")
    (row,) = parent_pom_remediation(files(p=[("pom.xml", text)]), deviations).collect()
    assert row.content == parent("x", "a", "1") + parent("g", "a", "9") + parent("g", "a", "2")


def test_checkouts_as_files(spark, tmp_path):
    target = tmp_path / "acme" / "shop" / "src"
    target.mkdir(parents=True)
    (target / "requirements.txt").write_text("nose\n")
    (tmp_path / "acme" / "shop" / "other.bin").write_text("x")
    (row,) = read_checkouts(spark, str(tmp_path), "*.txt").collect()
    assert (row.owner, row.repo, row.path, row.content) == ("acme", "shop", "src/requirements.txt", "nose\n")
