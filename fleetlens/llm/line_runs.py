"""Repeated lines, found batch by batch against levelled sorted runs of line hashes.

The key of a line is the line without white space at both ends, with A-Z in lower case. Keys are 128-bit hashes. A run is
a table of keys, bucketed and sorted by them; no key is in two runs. A new batch is merge-anti-joined with the runs: keys
that no run holds are new and become a run of level 0, all other lines of the batch repeat what came before. When a level
has ``FANOUT`` runs they are merged into one of the next level, so a key is rewritten once a level, and a batch meets a
number of runs that grows with the logarithm of the number of batches. Runs and the tables joined with them use the same
buckets, so the runs themselves are not shuffled.

Batches go from the largest document ids to the least: the first line of a key is the one that stays. Whether a key is
found in enough documents is decided over all repeats at the end. A key may stand in any share of the documents: lines
are joined by key and document, and counts by key and a salt of the document.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import cut_lineage, query, scratch_path, table, whole_text

SHORTEST, DOCUMENTS = 20, 3
BATCHES, FANOUT = 4, 3
# fixed values: the white space of the contract
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["a", "b"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, with A-Z in lower case."""
    inner = F.btrim(line, F.lit(SPACE))
    ascii = F.char_length(inner) == F.octet_length(inner)  # then ``lower`` changes A-Z only
    return F.when(ascii, F.lower(inner)).otherwise(F.translate(inner, _UPPER, _LOWER))


def key_hash(key: Column) -> list[Column]:
    """128 bits in two independent halves."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")]


class LineRuns:
    """Sorted runs of line keys in the shared folder; ``levels[i]`` lists the runs of level i as (table, path).

    ``state()`` is all another session needs to go on with the same runs (``LineRuns(spark, levels=...)``). A run is
    complete before it is listed, so a batch that fails leaves the runs as they were.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT, levels: list[list[str]] | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file
        self.levels = [[(self._open(path), path) for path in level] for level in levels or []]

    def state(self) -> list[list[str]]:
        return [[path for _, path in level] for level in self.levels]

    def _open(self, path: str) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (a BIGINT, b BIGINT) USING parquet CLUSTERED BY (a, b) SORTED BY (a, b) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _write(self, keys: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        dealt = keys.select(*KEY).repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        return name, path

    def close(self) -> None:
        """Forget the table names; the files stay."""
        for level in self.levels:
            for name, _ in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key is in no run, level by level from the largest runs on."""
        for level in reversed(self.levels):
            for name, _ in level:
                keys = keys.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """``keys``, which are in no run and differ, as a run of level 0; full levels are merged."""
        run, level = self._write(keys), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            if len(self.levels[level]) + 1 < self.fanout:
                self.levels[level].append(run)
                return
            merged = [*self.levels[level], run]
            union = self.spark.table(merged[0][0])
            for name, _ in merged[1:]:
                union = union.unionByName(self.spark.table(name))
            run = self._write(union)
            self.levels[level] = []
            for name, _ in merged:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1


def long_lines(docs: DataFrame, shortest: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``at`` (line number from 0), ``a``, ``b`` of every line whose key is long enough."""
    lines = F.split(whole_text(), "\n")
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), F.posexplode(lines).alias("at", "line"))
    rows = rows.filter(F.char_length("line") >= shortest).withColumn("key", line_key(F.col("line")))
    return rows.filter(F.char_length("key") >= shortest).select("doc_id", "text_hash", "at", *key_hash(F.col("key")))


def batches_of(lines: DataFrame, batches: int) -> list[Column]:
    """Conditions on ``doc_id`` that cut the lines into batches, the largest ids first, null ids in the last one."""
    shares = [i / batches for i in range(1, batches)]
    ids = lines.select(F.col("doc_id").cast("double").alias("x"))
    edges = sorted(set(ids.approxQuantile("x", shares, 0.2 / batches)), reverse=True) if shares else []
    id = F.col("doc_id").cast("double")
    upper = [None, *edges]
    conditions = []
    for high, low in zip(upper, [*edges, None], strict=True):
        condition = F.lit(True) if high is None else id < high
        if low is not None:
            condition = condition & (id >= low)
        elif high is not None:
            condition = condition | id.isNull()
        conditions.append(condition)
    return conditions


def repeated_lines(docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """``doc_id``, ``text_hash``, ``at`` of the lines that go: their key has at least ``shortest`` code points, is found in
    at least ``documents`` documents (different ids; rows without an id are one document, the least), and another document
    of a larger id holds it."""
    runs = LineRuns(docs.sparkSession)
    every = cut_lineage(long_lines(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), shortest), "lines")
    repeats = []
    for condition in batches_of(every, batches):
        lines = every.filter(condition)
        tops = lines.groupBy(*KEY).agg(F.max("doc_id").alias("top"))
        first = cut_lineage(runs.unseen(tops), "first-lines")
        stays = first.select(*KEY, F.col("top").alias("doc_id"))
        same = [lines[c] == stays[c] for c in KEY]
        repeats.append(cut_lineage(lines.join(stays, [*same, lines["doc_id"].eqNullSafe(stays["doc_id"])], "left_anti"), "repeats"))
        runs.add(first)
    runs.close()
    found = repeats[0]
    for more in repeats[1:]:
        found = found.unionByName(more)
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    # a salt holds whole documents, so the numbers of different documents add up
    counts = found.groupBy(*KEY, "salt", "doc_id").agg(F.lit(1).alias("one")).groupBy(*KEY, "salt").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*KEY))  # at most one row a salt
    often = counts.withColumn("total", total).filter(F.col("total") >= documents - 1).select(*KEY, "salt")
    return found.join(often, [*KEY, "salt"], "left_semi").select("doc_id", "text_hash", "at")


def without_repeated_lines(docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """``doc_id``, ``text``, ``n_lines``, ``n_dropped``, ``kept`` of every row of ``docs(doc_id, text)``: the text without
    its repeated lines, the others joined by a line feed. Other columns are ignored.

    A null or empty text is one empty line, and its ``kept`` is empty. Rows of one id are one document: they keep what
    that document keeps. An empty table gives an empty result. White space inside a line, and lines with short keys, stay.
    """
    drops = repeated_lines(docs, shortest, documents, batches).groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drops"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    both = rows["doc_id"].eqNullSafe(drops["doc_id"]) & (rows["text_hash"] == drops["text_hash"])
    joined = rows.join(drops, both, "left").select(rows["doc_id"], rows["text"], "drops")
    lines = joined.withColumns({"lines": F.split("text", "\n"), "drops": F.coalesce("drops", F.array().cast("array<int>"))})
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n")
    return lines.select(
        "doc_id",
        "text",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("drops").cast("bigint").alias("n_dropped"),
        F.when(F.size("drops") == 0, F.col("text")).otherwise(kept).alias("kept"),
    )


_SQL = rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS}),
marked AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.top AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op12_line_dedup", _SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that other documents hold as well."""
    rows = without_repeated_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
