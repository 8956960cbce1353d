"""Dependencies of Maven projects, resolved from the POM files of the fleet.

A POM becomes a model: coordinates, parent, properties, managed and declared dependencies. Models inherit along their
parents in rounds that double the reach (a parent's own pending parent is taken over), so a chain of n parents takes about
log n rounds. Then dependencies are resolved in rounds of growing depth: of each (root, group, artifact) only the best
path is kept, the nearest one and of several the one declared first; only what a round has added is followed further, so
cycles end. What was found lies in a table with as many buckets as the session has shuffle partitions, so each round is
shuffled, written and never shuffled again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage, scratch_path

DEPENDENCY = "struct<group:string,artifact:string,version:string,scope:string,optional:boolean,exclusions:array<string>>"
PROPERTY = "struct<name:string,value:string>"
#: What is not the project's own: taken out before its fields are read.
_FOREIGN = ("build", "profiles", "reporting")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _field(block: Column, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, f"<{tag}>\\s*([^<]*?)\\s*</{tag}>", 1)), F.lit(""))


def _block(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def _without(text: Column, *tags: str) -> Column:
    for tag in tags:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
    return text


def _dependencies(text: Column) -> Column:
    def one(block):
        own = _without(block, "exclusions")
        excluded = F.transform(
            F.regexp_extract_all(_block(block, "exclusions"), F.lit("(?s)<exclusion>(.*?)</exclusion>"), F.lit(1)),
            lambda e: F.concat(F.coalesce(_field(e, "groupId"), F.lit("*")), F.lit(":"), F.coalesce(_field(e, "artifactId"), F.lit("*"))),
        )
        return F.struct(
            _field(own, "groupId").alias("group"), _field(own, "artifactId").alias("artifact"), _field(own, "version").alias("version"),
            _field(own, "scope").alias("scope"), (F.lower(_field(own, "optional")) == "true").alias("optional"), excluded.alias("exclusions"),
        ).cast(DEPENDENCY)

    found = F.transform(F.regexp_extract_all(text, F.lit("(?s)<dependency>(.*?)</dependency>"), F.lit(1)), one)
    return F.filter(found, lambda d: d["group"].isNotNull() & d["artifact"].isNotNull())


def pom_model(content: Column) -> Column:
    """The model of a POM text; coordinates that it leaves to its parent are the parent's."""

    def model(text):
        parent = _block(text, "parent")
        own = _without(text, "parent", "dependencyManagement", "dependencies", "properties")
        names = F.regexp_extract_all(_block(text, "properties"), F.lit("<([A-Za-z0-9_.-]+)>([^<]*)</\\1>"), F.lit(1))
        values = F.regexp_extract_all(_block(text, "properties"), F.lit("<([A-Za-z0-9_.-]+)>([^<]*)</\\1>"), F.lit(2))
        return F.struct(
            F.coalesce(_field(own, "groupId"), _field(parent, "groupId")).alias("group"),
            _field(own, "artifactId").alias("artifact"),
            F.coalesce(_field(own, "version"), _field(parent, "version")).alias("version"),
            F.struct(*[_field(parent, tag).alias(name) for tag, name in (("groupId", "group"), ("artifactId", "artifact"), ("version", "version"))]).alias("parent"),
            F.arrays_zip(names.alias("name"), F.transform(values, lambda v: F.trim(v)).alias("value")).cast(f"array<{PROPERTY}>").alias("properties"),
            _dependencies(_block(text, "dependencyManagement")).alias("managed"),
            _dependencies(_without(text, "dependencyManagement")).alias("dependencies"),
        )

    return let(_without(F.regexp_replace(content, "(?s)<!--.*?-->", ""), *_FOREIGN), model)


def coordinates(group: Column, artifact: Column, version: Column) -> Column:
    """``group:artifact:version``; null if one is missing."""
    return F.concat(group, F.lit(":"), artifact, F.lit(":"), version)


def _filled(text: Column, properties: Column) -> Column:
    """``text`` with ``${name}`` replaced, also in the values of properties; unknown names stay."""
    once = lambda t: F.aggregate(properties, t, lambda x, p: F.replace(x, F.concat(F.lit("${"), p["name"], F.lit("}")), p["value"]))
    again = lambda t, _: F.when(F.contains(t, F.lit("${")), once(t)).otherwise(t)
    return F.when(F.contains(text, F.lit("${")), F.aggregate(properties, text, again)).otherwise(text)


def _first(items: Column, dependency: Column) -> Column:
    same = lambda m: (m["group"] == dependency["group"]) & (m["artifact"] == dependency["artifact"])
    return F.get(F.filter(items, same), F.lit(0))


def effective_models(poms: DataFrame) -> DataFrame:
    """(id, group, artifact, version, managed, dependencies) of ``poms(content)``, with what the parents among them give.

    A child comes before its parent: the first property, managed or declared dependency of a name counts. Of several
    POMs with the same coordinates the greatest by ``age`` (if there is such a column), then by text, is taken. Parents
    that are not in the fleet give nothing; parents in a circle are each taken once.
    """
    age = F.col("age") if "age" in poms.columns else F.lit(0)
    models = poms.select(pom_model(F.col("content")).alias("m"), F.struct(age.alias("a"), "content").alias("age")).select("m.*", "age")
    own = models.withColumns({c: _filled(F.col(c), F.col("properties")) for c in ("group", "artifact", "version")})
    own = own.withColumn("id", coordinates(F.col("group"), F.col("artifact"), F.col("version"))).filter("id IS NOT NULL")
    fields = ["group", "artifact", "version", "parent", "properties", "managed", "dependencies"]
    own = own.groupBy("id").agg(F.max_by(F.struct(*fields), "age").alias("m")).select("id", "m.*")
    pending = coordinates(F.col("parent.group"), F.col("parent.artifact"), F.col("parent.version"))
    line = cut_lineage(own.withColumn("pending", F.nullif(pending, F.col("id"))).withColumn("seen", F.array("id")), "models")
    while not line.filter("pending IS NOT NULL").isEmpty():
        up = line.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("properties", "managed", "dependencies", "pending", "seen")])
        joined = line.join(up, F.col("pending") == F.col("_id"), "left")
        grown = {c: F.concat(c, F.coalesce(f"_{c}", F.array())) for c in ("properties", "managed", "dependencies")}
        circle = F.exists("seen", lambda s: s == F.col("_pending"))
        rest = F.when(~circle, F.col("_pending"))
        joined = joined.withColumns({**grown, "pending": rest, "seen": F.concat("seen", F.coalesce("_seen", F.array().cast("array<string>")))})
        line = cut_lineage(joined.select(*line.columns), "models")
    known = {"project.groupId": "group", "project.artifactId": "artifact", "project.version": "version", "pom.version": "version"}
    given = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in known.items()],
        F.struct(F.lit("project.parent.version").alias("name"), F.coalesce("parent.version", F.lit("")).alias("value")),
    ).cast(f"array<{PROPERTY}>")
    line = line.withColumn("properties", F.concat("properties", given))

    def filled(d, managed=None):
        text = {c: _filled(d[c], F.col("properties")) for c in ("group", "artifact", "version", "scope")}
        return F.struct(*[v.alias(c) for c, v in text.items()], d["optional"].alias("optional"), d["exclusions"].alias("exclusions")).cast(DEPENDENCY)

    line = line.withColumns({c: F.transform(c, filled) for c in ("managed", "dependencies")})

    def with_management(d):
        return let(_first(F.col("managed"), d), lambda m: F.struct(
            d["group"].alias("group"), d["artifact"].alias("artifact"), F.coalesce(d["version"], m["version"]).alias("version"),
            F.coalesce(d["scope"], m["scope"], F.lit("compile")).alias("scope"), F.coalesce(d["optional"], m["optional"], F.lit(False)).alias("optional"),
            F.concat(d["exclusions"], F.coalesce(m["exclusions"], F.array().cast("array<string>"))).alias("exclusions"),
        ).cast(DEPENDENCY))

    line = line.withColumn("dependencies", F.transform("dependencies", with_management))
    return cut_lineage(line.select("id", "group", "artifact", "version", "managed", "dependencies"), "models")


class Bucketed:
    """Rows in the shared folder, dealt by ``KEY`` into the session's number of shuffle partitions; a join by ``KEY`` does not
    shuffle them."""

    KEY = ("root", "group", "artifact")

    def __init__(self, rows: DataFrame):
        self.spark, self.name = rows.sparkSession, f"maven_{uuid.uuid4().hex}"
        self.path, self.schema = scratch_path(self.spark, "maven"), rows.schema
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.add(rows.repartition(self.buckets, *self.KEY))

    def add(self, rows: DataFrame) -> None:
        """Append ``rows``, which should come grouped by ``KEY``: else every task writes a file for every bucket."""
        writer = rows.select(*self.schema.names).write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, *self.KEY).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """The rows, read by their path; the name of the table is forgotten."""
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)


def _inherited(outer: Column, inner: Column) -> Column:
    """The scope of a dependency of a dependency."""
    return F.when(outer == "compile", inner).otherwise(outer)


def resolve(models: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, group, artifact, version, scope, depth, direct) of all dependencies of ``roots(root)``, ids of ``models``.

    The nearest declaration of a (group, artifact) gives its version; among equally near ones the first along the paths.
    What the root manages counts for all versions below it. Optional, test and provided dependencies of dependencies are
    left out, so is what an exclusion on the path names (``*`` stands for all). Dependencies without a POM in the fleet
    have no further ones; those without a version have a null version. A root does not depend on itself.
    """
    edges = models.select(F.col("id").alias("from"), F.posexplode("dependencies").alias("at", "d")).select("from", "at", "d.*")
    edges = cut_lineage(edges, "edges")
    wanted = roots.select("root").distinct().join(models.withColumnRenamed("id", "root"), "root")
    pinned = wanted.select("root", F.posexplode("managed").alias("at", "m")).filter("m.version IS NOT NULL")
    pinned = pinned.groupBy("root", F.col("m.group").alias("group"), F.col("m.artifact").alias("artifact")).agg(F.min_by("m.version", "at").alias("pin"))
    pinned = Bucketed(pinned)
    number = F.lit(0).cast("bigint").alias("depth")
    none = F.array().cast("array<string>")
    text, path = F.lit(None).cast("string"), F.array().cast("array<int>")
    found_at = Bucketed(wanted.select("root", "group", "artifact", text.alias("version"), text.alias("scope"), path.alias("path"), none.alias("banned"), number))
    frontier = wanted.select("root", F.col("root").alias("id"), F.lit("compile").alias("outer"), F.array().cast("array<int>").alias("path"), none.alias("banned"))
    depth = 0
    while True:
        depth += 1
        found = frontier.join(edges, F.col("id") == F.col("from"))
        if depth > 1:
            found = found.filter(~F.col("optional") & F.col("scope").isin("compile", "runtime"))
        banned = F.exists("banned", lambda b: b.isin("*:*") | (b == F.concat("group", F.lit(":*"))) | (b == F.concat(F.lit("*:"), F.col("artifact"))) | (b == F.concat("group", F.lit(":"), F.col("artifact"))))
        found = found.filter(~banned).withColumns({
            "path": F.concat("path", F.array("at")),
            "scope": _inherited(F.col("outer"), F.col("scope")) if depth > 1 else F.col("scope"),
            "banned": F.array_distinct(F.concat("banned", "exclusions")),
        })
        best = found.groupBy("root", "group", "artifact").agg(F.min_by(F.struct("version", "scope", "path", "banned"), "path").alias("b"))
        best = best.join(found_at.read().select(*Bucketed.KEY), [*Bucketed.KEY], "left_anti").select("root", "group", "artifact", "b.*")
        if depth > 1:
            best = best.join(pinned.read(), [*Bucketed.KEY], "left").withColumn("version", F.coalesce("pin", "version")).drop("pin")
        found_at.add(best.withColumn("depth", F.lit(depth).cast("bigint")))
        best = found_at.read().filter(F.col("depth") == depth)
        if best.isEmpty():
            break
        frontier = best.select("root", coordinates(F.col("group"), F.col("artifact"), F.col("version")).alias("id"), F.col("scope").alias("outer"), "path", "banned")
    columns = ["root", "group", "artifact", "version", "scope", "depth", (F.col("depth") == 1).alias("direct")]
    pinned.close()
    return found_at.close().filter("depth > 0").select(*columns)
