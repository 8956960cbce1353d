"""Policy: target facts, deviations from them, and how targets come about.

Targets are joined by (type, name) without a broadcast hint: adaptive execution
broadcasts them when their measured size allows it, and splits hot names of the
fact side when it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.names import npm_name_decode, npm_name_encode
from fleetlens.functions.payload import sha_of
from fleetlens.functions.versions import KEY as VERSION_KEY
from fleetlens.functions.versions import base_version, drift_class, in_terms, precedence, range_terms, satisfies
from fleetlens.operators.extractors import NPM
from fleetlens.session import cut_lineage

IDEAL_REASON = "latest from NPM"
#: Rows that a task sorts by time.
ROWS_PER_RANGE = 1 << 18


def modal_targets(facts: DataFrame) -> DataFrame:
    """Most used variant per (type, name); the smallest payload among equals."""
    counts = facts.groupBy("type", "name", "data", "sha").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("type", "name").agg(
        F.min_by(F.struct("data", "sha"), F.struct(-F.col("n"), F.col("data"))).alias("t")
    ).select("type", "name", F.col("t.data").alias("target_data"), F.col("t.sha").alias("target_sha"))


def target_diff(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts that deviate from the target of the same (type, name)."""
    return facts.join(targets, ["type", "name"]).filter(F.col("sha") != F.col("target_sha"))


def declared_range(type_: Column, data: Column) -> Column:
    """The range a library fact declares; null for other facts."""
    return F.when(type_ == NPM, F.get_json_object(data, "$[1]"))


def admits(type_: Column, data: Column, target_data: Column) -> Column:
    """Whether the declared range of a fact lets the version of the target in; null if there is no range to read."""
    return satisfies(base_version(declared_range(type_, target_data)), declared_range(type_, data))


def outside_range(deviations: DataFrame) -> DataFrame:
    """Deviations that an install would not resolve to the target; facts without a range stay."""
    return deviations.filter(~F.coalesce(admits(F.col("type"), F.col("data"), F.col("target_data")), F.lit(False)))


def policy_compliance(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts and share of facts on target per (type, name), and how many declare the target or a range that admits it.

    Variants are counted first, so a range is read once and not once a repository.
    """
    counts = facts.groupBy("type", "name", "data", "sha").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(targets.select("type", "name", "target_data", "target_sha"), ["type", "name"])
    on_target = F.col("sha") == F.col("target_sha")
    admitted = on_target | F.coalesce(admits(F.col("type"), F.col("data"), F.col("target_data")), F.lit(False))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return joined.groupBy("type", "name").agg(
        F.sum("n").alias("repos"),
        total(on_target).alias("on_target"),
        F.round(total(on_target) / F.sum("n"), 6).alias("share"),
        total(admitted).alias("admitted"),
    )


def target_asof(facts: DataFrame, history: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Each fact (with ``ts``) with the target that was valid at that time; facts before the first target are left out.

    ``history`` is (type, name, target_data, valid_from, ...); targets that start after ``as_of`` are not read. Facts and
    targets are merged in the order of time: rows are range partitioned by (type, name, time), the last target is carried
    along each range, and into later ranges of the key by a summary of one row per range. No interval is unfolded, and
    the facts of one name lie in as many ranges as they fill. A range has at most some ``ROWS_PER_RANGE`` rows, or the
    share of one of the session's shuffle partitions. Facts are counted, sampled and dealt: store them first if they are
    costly to compute.
    """
    key, fields = ["type", "name"], [c for c in history.columns if c not in ("type", "name")]
    kept = [c for c in facts.columns if c not in key]
    if as_of is not None:
        history = history.filter(F.col("valid_from") <= as_of)
    time = facts.schema["ts"].dataType
    target, fact = F.struct(*fields).alias("_target"), F.struct(*kept).alias("_fact")
    starts = history.select(*key, F.col("valid_from").cast(time).alias("_at"), target, F.lit(None).cast(facts.select(fact).schema[0].dataType).alias("_fact"))
    uses = facts.select(*key, F.col("ts").alias("_at"), F.lit(None).cast(history.select(target).schema[0].dataType).alias("_target"), fact)
    rows = starts.unionByName(uses).withColumns({
        "_use": F.col("_fact").isNotNull(),  # a target counts for the facts of its own instant
        "_tie": F.coalesce(F.col("_target.target_data"), F.xxhash64("_fact").cast("string")),
    })
    order = ["_at", "_use", "_tie"]
    ranges = -(-facts.count() // ROWS_PER_RANGE)
    number = [ranges] if ranges > int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ranged = rows.repartitionByRange(*number, *key, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged, "asof-ranges")  # cut points are sampled, and used twice
    along = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = ranged.repartition(ranges, "_range", *key) if number else ranged
    merged = dealt.withColumn("_here", F.last("_target", ignorenulls=True).over(along)).filter("_use")
    ends = ranged.groupBy(*key, "_range").agg(F.max_by("_target", F.when(~F.col("_use"), F.struct("_at", "_tie"))).alias("_end"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).select(*key, "_range", "_before")
    valid = merged.join(carried, [*key, "_range"]).withColumn("_t", F.coalesce("_here", "_before")).filter("_t IS NOT NULL")
    return valid.select(*key, *[F.col("_fact")[c].alias(c) for c in kept], *[F.col("_t")[c].alias(c) for c in fields])


def promote_target(coordinate_diffs: DataFrame, channels: DataFrame) -> DataFrame:
    """A new coordinates fact proposes its (name, version) as a library target.

    ``channels`` is (repo, channel); without a channel the vote is to abstain.
    """
    lib = F.get_json_object("to_data", "$.name")
    version = F.get_json_object("to_data", "$.version")
    data = F.to_json(F.array(lib, version))
    has_channel = F.col("channel").isNotNull()
    return (
        coordinate_diffs.filter(F.col("to_data").isNotNull())
        .join(channels, "repo", "left")
        .select(
            "repo",
            "push_id",
            "channel",
            F.when(has_channel, "set-target").otherwise("abstain").alias("vote"),
            F.when(has_channel, F.lit(NPM)).alias("type"),
            F.when(has_channel, npm_name_encode(lib)).alias("name"),
            F.when(has_channel, data).alias("target_data"),
            F.when(has_channel, sha_of(data)).alias("target_sha"),
        )
    )


def upsert_targets(targets: DataFrame, promoted: DataFrame) -> DataFrame:
    """Targets after promotion; both inputs carry ``valid_from``, the newest wins."""
    fields = ["type", "name", "target_data", "target_sha", "valid_from"]
    votes = promoted.filter(F.col("type").isNotNull()) if "vote" in promoted.columns else promoted
    both = targets.select(*fields).unionByName(votes.select(*fields))
    newest = F.max_by(F.struct("target_data", "target_sha", "valid_from"), F.struct("valid_from", "target_data"))
    return both.groupBy("type", "name").agg(newest.alias("t")).select("type", "name", "t.*")


def ideal_versions(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Newest published version of every library in use, by precedence among those published together; unknown libraries
    give no row."""
    used = facts.filter(F.col("type") == NPM).select("name").distinct().withColumn("lib", npm_name_decode(F.col("name")))
    order = F.struct(F.col("published"), precedence(base_version(F.col("version"))), F.col("version"))
    latest = registry.groupBy("lib").agg(F.max_by("version", order).alias("version"))
    data = F.to_json(F.array("lib", "version"))
    return used.join(latest, "lib").select(
        F.lit(NPM).alias("type"),
        "name",
        data.alias("ideal_data"),
        sha_of(data).alias("ideal_sha"),
        F.lit(IDEAL_REASON).alias("reason"),
    )


def resolved_versions(facts: DataFrame, published: DataFrame) -> DataFrame:
    """What every declared range of a library resolves to: (lib, range, uses, resolved, newest, drift).

    ``published`` is (lib, version). ``resolved`` is the highest published version in the range, ``newest`` the highest
    release, ``drift`` the place in which the resolved version (or, if nothing published fits, the one the range starts
    from) is behind it. The versions of a library, some thousands at most, are gathered once for each library, not for
    each use; ranges are counted first. Libraries that are not published have null versions.
    """
    lib = F.get_json_object("data", "$[0]").alias("lib")
    ranges = facts.filter(F.col("type") == NPM).groupBy("data").agg(F.count(F.lit(1)).alias("uses"))
    ranges = ranges.select(lib, F.get_json_object("data", "$[1]").alias("range"), "uses")
    known = published.select("lib", F.struct(precedence(F.col("version")).alias("key"), "version").alias("v")).filter("v.key IS NOT NULL")
    known = known.groupBy("lib").agg(F.sort_array(F.collect_set("v"), asc=False).alias("versions"))
    joined = ranges.join(known, "lib", "left").withColumn("terms", range_terms(F.col("range")))
    fits = lambda v: in_terms(v["key"], F.col("terms"))
    first = lambda found: F.get(found, F.lit(0))  # noqa: E731  (the highest)
    joined = joined.withColumn("best", first(F.filter("versions", fits))).withColumn("top", first(F.filter("versions", lambda v: v["key"]["release"])))
    own = F.coalesce(F.col("best.key"), precedence(base_version(F.col("range")))).cast(VERSION_KEY)
    return joined.select("lib", "range", "uses", F.col("best.version").alias("resolved"), F.col("top.version").alias("newest"), drift_class(own, F.col("top.key")).alias("drift"))


def version_drift(resolved: DataFrame) -> DataFrame:
    """Uses per library by how far they are behind: (lib, uses, major, minor, patch, current)."""
    total = lambda kind: F.sum(F.when(F.col("drift") == kind, F.col("uses")).otherwise(0))
    return resolved.groupBy("lib").agg(F.sum("uses").alias("uses"), *[total(k).alias(k) for k in ("major", "minor", "patch")], total("none").alias("current"))
