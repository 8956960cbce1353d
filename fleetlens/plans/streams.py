"""Streaming queries: all available input is processed and the sink is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import aspects as a
from fleetlens.operators import targets
from fleetlens.operators.aspects import extract_facts
from fleetlens.operators.diff import fingerprint_diff
from fleetlens.operators.scores import commit_risk
from fleetlens.plans.judgement import COMMIT_RISK_SQL
from fleetlens.plans.policy import channels
from fleetlens.plans.registry import query
from fleetlens.plans.sources import default_pushes, npm_facts, with_push_time
from fleetlens.plans.sql import with_ctes
from fleetlens.session import cut_lineage, scratch_path
from fleetlens.sources.driver import Fleet
from fleetlens.streaming import jobs


def _default_facts(fleet: Fleet) -> DataFrame:
    return with_push_time(npm_facts(fleet, default_pushes(fleet)), fleet)


#: Every twentieth push arrives a wave late; waves are shorter than this.
LATE, DELAY = 20, "3650 days"
FACTS_PER_SLICE = 512


def _in_waves(fleet: Fleet, label: str, waves: int, write, log) -> DataFrame:
    """Let the facts arrive in waves of event time, some late, and run the job after each wave from its checkpoint. The
    log is compacted on the way."""
    facts = _default_facts(fleet).select("repo", "type", "name", "push_id", "ts", "sha")
    days = F.datediff("ts", F.lit("1970-01-01"))
    span = fleet.pushes().agg(F.min(days).alias("first"), F.max(days).alias("last")).first()
    length = (span["last"] - span["first"] + 1) / waves if span["last"] is not None else 1
    late = F.when(F.pmod(F.xxhash64("push_id"), F.lit(LATE)) == 0, 1).otherwise(0)
    wave = F.least(F.floor((days - F.lit(span["first"])) / length) + late, F.lit(waves - 1))
    rows = cut_lineage(facts.withColumn("wave", wave), f"{label}-waves")
    slices = max(1, rows.count() // FACTS_PER_SLICE)
    arrived, location = scratch_path(fleet.spark, f"{label}-in"), scratch_path(fleet.spark, label)
    for i in range(waves):
        rows.filter(F.col("wave") == i).drop("wave").write.mode("append").parquet(arrived)
        out = write(jobs.read_folder_stream(fleet.spark, arrived, facts.schema), location, DELAY, slices=slices)
        if i == waves // 2:
            log(fleet.spark, f"{location}/{label}").compact()
    return out


def _event_stream(fleet: Fleet) -> DataFrame:
    """Delivery events straight from the events table as a stream."""
    raw = jobs.read_table_stream(fleet.spark, fleet.sf_dir, "events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "build").when(F.col("event_type") == "error", "build-failed")
    kind = kind.when(F.col("event_type") == "signup", "tag-confirmed").otherwise("push")
    return raw.select("event_id", F.col("user_id").alias("repo"), "ts", kind.alias("kind"), "value")


@query("push_stream", with_ctes("SELECT repo, push_id, branch FROM pushes WHERE is_default", "pushes"))
def _push_stream(fleet: Fleet) -> DataFrame:
    raw = jobs.read_table_stream(fleet.spark, fleet.sf_dir, "orders.parquet")
    pushes = raw.select(
        F.col("o_custkey").alias("repo"),
        F.col("o_orderkey").alias("push_id"),
        F.lit("master").alias("branch"),
        (F.col("o_orderstatus") == "F").alias("is_default"),
    )
    return jobs.run_available(jobs.default_pushes(pushes).select("repo", "push_id", "branch"), "push-stream")


@query(
    "stream_fingerprints",
    with_ctes("SELECT repo, push_id, type, name, data, sha FROM dep JOIN pushes USING (push_id) WHERE is_default", "dep", "pushes"),
)
def _stream_fingerprints(fleet: Fleet) -> DataFrame:
    files = jobs.arrive(fleet.files(["package.json"], default_pushes(fleet)), "files")
    facts = jobs.fingerprints(files, [a.NPM], ["repo", "push_id"])
    return jobs.run_available(facts.select("repo", "push_id", "type", "name", "data", "sha"), "facts")


@query(
    "stream_latest",
    with_ctes(
        """SELECT repo, type, name, push_id, sha FROM dep JOIN pushes USING (push_id) WHERE is_default
        QUALIFY row_number() OVER (PARTITION BY repo, type, name ORDER BY ts DESC, push_id DESC, sha DESC) = 1""",
        "dep", "pushes",
    ),
)
def _stream_latest(fleet: Fleet) -> DataFrame:
    return _in_waves(fleet, "latest", 3, jobs.write_latest, jobs.latest_log)


@query(
    "stream_diffs",
    with_ctes(
        """SELECT repo, type, name, push_id, from_sha, sha AS to_sha FROM (SELECT repo, type, name, push_id, sha,
        lag(sha) OVER (PARTITION BY repo, type, name ORDER BY ts, push_id) AS from_sha FROM dep JOIN pushes USING (push_id)
        WHERE is_default) WHERE from_sha <> sha""",
        "dep", "pushes",
    ),
)
def _stream_diffs(fleet: Fleet) -> DataFrame:
    return _in_waves(fleet, "changes", 5, jobs.write_changes, jobs.change_log)


@query(
    "stream_target_diff",
    with_ctes(
        """SELECT repo, push_id, dep.name, dep.data, target_data FROM dep JOIN pushes USING (push_id)
        JOIN target ON target.name = dep.name WHERE is_default AND dep.sha <> target_sha""",
        "dep", "pushes", "target",
    ),
)
def _stream_target_diff(fleet: Fleet) -> DataFrame:
    policy = targets.modal_targets(npm_facts(fleet, fleet.latest_pushes()))
    facts = jobs.arrive(npm_facts(fleet, default_pushes(fleet)), "facts")
    alerts = jobs.target_alerts(facts, policy)
    return jobs.run_available(alerts.select("repo", "push_id", "name", "data", "target_data"), "alerts")


@query("stream_commit_risk", with_ctes(COMMIT_RISK_SQL, "pf"))
def _stream_commit_risk(fleet: Fleet) -> DataFrame:
    return jobs.run_available(commit_risk(jobs.arrive(fleet.pushes_with_files(), "pushes")), "risk")


_WINDOWED = """SELECT repo, strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS builds, max(value) AS max_seconds
    FROM ({rows}) WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) FROM ev WHERE kind = 'build') - INTERVAL 1 DAY GROUP BY repo, s"""


@query(
    "stream_build_time",
    with_ctes(_WINDOWED.format(rows="SELECT repo, value, date_trunc('day', ts)::TIMESTAMP AS s FROM ev WHERE kind = 'build'"), "ev"),
)
def _stream_build_time(fleet: Fleet) -> DataFrame:
    return jobs.run_available(jobs.build_time_windows(_event_stream(fleet), "1 day"), "build-time")


@query(
    "stream_build_time_sliding",
    with_ctes(
        _WINDOWED.format(
            rows="""SELECT repo, value, time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS * k AS s FROM ev,
            (VALUES (0), (1), (2), (3)) v(k) WHERE kind = 'build'"""
        ),
        "ev",
    ),
)
def _stream_build_time_sliding(fleet: Fleet) -> DataFrame:
    return jobs.run_available(jobs.build_time_windows(_event_stream(fleet), "1 day", "6 hours"), "build-time")


@query(
    "stream_push_sessions",
    with_ctes(
        """SELECT repo, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS pushes FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY ts, event_id) AS session FROM (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY repo ORDER BY ts, event_id) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh
        FROM ev WHERE kind = 'push')) GROUP BY repo, session
        HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) FROM ev WHERE kind = 'push') - INTERVAL 1 DAY""",
        "ev",
    ),
)
def _stream_push_sessions(fleet: Fleet) -> DataFrame:
    return jobs.run_available(jobs.push_sessions(_event_stream(fleet)), "sessions")


@query("stream_dedup", with_ctes("SELECT event_id, repo, kind, value FROM ev", "ev"))
def _stream_dedup(fleet: Fleet) -> DataFrame:
    """Every event is delivered twice and kept once."""
    events = fleet.delivery_events()
    stream = jobs.arrive(events.unionByName(events), "events")
    return jobs.run_available(jobs.deduplicated(stream).select("event_id", "repo", "kind", "value"), "dedup")


@query(
    "stream_promote_target",
    with_ctes(
        """SELECT 'npm-project-deps' AS type, 'fleet::repo-' || repo AS name, arg_max(d, push_id) AS target_data,
        sha256(arg_max(d, push_id)) AS target_sha FROM (SELECT repo, push_id,
        '["@fleet/repo-' || repo || '","1.' || push_id % 10 || '.0"]' AS d
        FROM chain WHERE repo % 2 = 0 AND prev_push IS NOT NULL AND push_id % 10 <> prev_push % 10) GROUP BY repo""",
        "chain",
    ),
)
def _stream_promote_target(fleet: Fleet) -> DataFrame:
    pushes = default_pushes(fleet)
    facts = extract_facts(fleet.files(["package.json"], pushes), [a.NPM_COORDINATES])
    stream = jobs.arrive(fingerprint_diff(facts, pushes), "diffs")
    return jobs.promoted_targets(stream, channels(fleet), scratch_path(fleet.spark, "targets"))
