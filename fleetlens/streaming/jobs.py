"""Streaming jobs over files, facts, pushes and delivery events.

The stateless jobs call the same functions as the batch jobs. Event time is
UTC; the inputs store it without a zone, and watermarks need an instant, so it
is cast on the way in and back on the way out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fleetlens.operators.aspects import Aspect, extract_facts
from fleetlens.operators.sequencing import number_rows
from fleetlens.operators.targets import promote_target
from fleetlens.session import scratch_path
from fleetlens.streaming.changelog import Changelog
from fleetlens.streaming.state import KEY, SLICES, told_facts, with_keyed_state


# --- sources and sinks -------------------------------------------------------


def read_table_stream(spark: SparkSession, folder: str, file_name: str, schema: str | None = None) -> DataFrame:
    """New files of one name in a folder as a stream."""
    known = spark.read.parquet(f"{folder}/{file_name}").schema if schema is None else schema
    return spark.readStream.schema(known).option("pathGlobFilter", file_name).parquet(folder)


def read_folder_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder that a table writer appends to, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def arrive(df: DataFrame, label: str) -> DataFrame:
    """Write a batch table to the shared folder and read it as a stream."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return read_folder_stream(df.sparkSession, path, df.schema)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process all available input in append mode and return what was written."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_each_batch(
    stream: DataFrame, out: str, checkpoint: str, mode: str, write: Callable[[DataFrame, int, str], None]
) -> None:
    """Run ``write(batch, id, path)`` on every micro-batch.

    A batch may be retried after a failure, so ``write`` puts its result into
    a folder of its own id under ``out`` and overwrites it.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: write(batch, batch_id, f"{out}/batch={batch_id}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- stateless jobs -----------------------------------------------------------


def default_pushes(pushes: DataFrame) -> DataFrame:
    return pushes.filter("is_default")


def fingerprints(files: DataFrame, aspects: list[Aspect], keep: list[str]) -> DataFrame:
    """Facts of arriving files, by the batch extractor."""
    return extract_facts(files, aspects, keep)


def target_alerts(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Arriving facts that deviate from policy; the static side is re-read per batch."""
    return facts.join(targets, ["type", "name"]).filter(F.col("sha") != F.col("target_sha"))


# --- stateful jobs --------------------------------------------------------------


def instant(ts: str) -> Column:
    return F.col(ts).cast("timestamp")


STATE_FIELDS = ["repo", "type", "name", "push_id", "ts", "sha"]
CHANGE_FIELDS = ["repo", "type", "name", "push_id", "from_sha", "to_sha"]


def batch_changes(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Changes a micro-batch brings per (repo, type, name), given the state before it.

    Rows are in the order of their events, so a late push never counts as newer
    than the state. When it stands right before the state row of its key and
    differs, the change of that later push is told again, now from the late
    push. Rows are numbered across ranges and compared with their predecessor by
    an equi join, so a key that fills a third of a batch is spread like any other.
    """
    key = F.to_json(F.struct("repo", "type", "name"))
    rows = state.select(*STATE_FIELDS, F.lit(False).alias("_new")).unionByName(
        batch.select(*STATE_FIELDS, F.lit(True).alias("_new"))
    )
    numbered = number_rows(rows.withColumn("_fact", key), "_fact", ["ts", "push_id", "_new", "sha"])
    before = numbered.select(
        F.col("_fact").alias("_f"), (F.col("seq") + 1).alias("_s"), F.col("sha").alias("from_sha"), F.col("_new").alias("_late")
    )
    joined = numbered.join(before, (F.col("_fact") == F.col("_f")) & (F.col("seq") == F.col("_s")))
    return joined.filter((F.col("_new") | F.col("_late")) & (F.col("from_sha") != F.col("sha"))).select(
        "repo", "type", "name", "push_id", "from_sha", F.col("sha").alias("to_sha")
    )


def _slices(spark: SparkSession, location: str, slices: int) -> int:
    """``slices``, or what the job at ``location`` was started with: its state stays where it is."""
    path = f"{location}/slices"
    try:
        return spark.read.schema("slices bigint").json(path).first()[0]
    except AnalysisException:  # the first run
        spark.range(1).select(F.lit(slices).cast("bigint").alias("slices")).write.json(path)
        return slices


def _tell(facts: DataFrame, log: Changelog, location: str, delay: str, expire_days: int | None, slices: int, keep: Column) -> DataFrame:
    """Run the keyed state over what has arrived, append its rows to the log and return the table they stand for."""
    told = told_facts(facts, delay, expire_days, _slices(facts.sparkSession, location, slices)).filter(keep).select(*log.schema.names)
    with with_keyed_state(facts.sparkSession):
        run_each_batch(told, location, f"{location}/checkpoint", "update", lambda batch, id, path: log.write(batch, id))
    return log.read()


def change_log(spark: SparkSession, location: str) -> Changelog:
    """Changes by push; of several tellings of one push the last holds."""
    schema = "repo bigint, type string, name string, push_id bigint, from_sha string, to_sha string"
    return Changelog(spark, location, spark.createDataFrame([], schema).schema, ["repo", "type", "name", "push_id", "to_sha"], ["batch"])


def latest_log(spark: SparkSession, location: str) -> Changelog:
    schema = "repo bigint, type string, name string, push_id bigint, millis bigint, to_sha string"
    return Changelog(spark, location, spark.createDataFrame([], schema).schema, KEY, ["millis", "push_id", "to_sha", "batch"])


def write_changes(facts: DataFrame, location: str, delay: str = "3650 days", expire_days: int | None = None, slices: int = SLICES) -> DataFrame:
    """Append change events under ``location`` and return all that hold.

    A fact is compared with the one before it in the order of events, kept per (repo, type, name) as in
    ``streaming.state``. A push that comes late, by at most ``delay``, is told with its predecessor, and its successor is
    told again. A retried batch overwrites its own output and a restarted job goes on from its checkpoint, with the
    ``slices`` of its first run.
    """
    told = F.col("from_sha").isNotNull() & (F.col("again") | (F.col("from_sha") != F.col("to_sha")))
    changes = _tell(facts, change_log(facts.sparkSession, f"{location}/changes"), location, delay, expire_days, slices, told)
    return changes.filter("from_sha != to_sha").select(*CHANGE_FIELDS)


def write_latest(facts: DataFrame, location: str, delay: str = "3650 days", expire_days: int | None = None, slices: int = SLICES) -> DataFrame:
    """Append the newest fact per (repo, type, name) whenever it changes and return the current ones."""
    told = F.col("newest") & ~F.col("again")
    latest = _tell(facts, latest_log(facts.sparkSession, f"{location}/latest"), location, delay, expire_days, slices, told)
    return latest.select(*KEY, "push_id", F.col("to_sha").alias("sha"))


def build_time_windows(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Builds and their durations per repo and window, emitted when a window has closed."""
    builds = events.filter(F.col("kind") == "build").withColumn("at", instant("ts")).withWatermark("at", delay)
    span = F.window("at", size, slide) if slide else F.window("at", size)
    return (
        builds.groupBy(span, "repo")
        .agg(F.count("*").alias("builds"), F.max("value").alias("max_seconds"))
        .select("repo", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "builds", "max_seconds")
    )


def push_sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Bursts of pushes per repo, emitted when a burst has ended."""
    pushes = events.filter(F.col("kind") == "push").withColumn("at", instant("ts")).withWatermark("at", delay)
    return (
        pushes.groupBy(F.session_window("at", gap), "repo")
        .agg(F.count("*").alias("pushes"))
        .select("repo", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "pushes")
    )


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Re-delivered events once."""
    marked = events.withColumn("at", instant("ts")).withWatermark("at", delay)
    return marked.dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def promoted_targets(coordinate_diffs: DataFrame, channels: DataFrame, location: str) -> DataFrame:
    """Targets proposed by coordinate changes, upserted batch by batch; newest push wins."""

    def write(batch: DataFrame, batch_id: int, path: str) -> None:
        votes = promote_target(batch, channels).filter(F.col("type").isNotNull())
        votes.select("type", "name", "target_data", "target_sha", "push_id").write.mode("overwrite").parquet(path)

    run_each_batch(coordinate_diffs, f"{location}/targets", f"{location}/checkpoint", "append", write)
    log = coordinate_diffs.sparkSession.read.parquet(f"{location}/targets")
    newest = F.max_by(F.struct("target_data", "target_sha"), "push_id")
    return log.groupBy("type", "name").agg(newest.alias("t")).select("type", "name", "t.*")
