"""What the text operators share: tables, settings, byte views of Arrow text, and vectorised hashing of words.

Text columns go through Arrow batches. A null text counts as an empty one in every operator. Work inside a batch is
done in slices of about ``SLICE_BYTES`` bytes, so the memory of a task does not depend on how many rows a batch has;
only a single text longer than that makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage, scratch_path, shared_dir  # noqa: F401  (used by the operators)

#: Rows in an Arrow batch; texts of 20,000 words make a batch of 1,000 rows about 130 MB at most.
BATCH_ROWS = 1000
SLICE_BYTES = 4 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def query(name: str, sql: str | None = None):
    """Register ``job(spark, sf_dir) -> DataFrame`` under a name."""

    def add(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return job

    return add


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as rows hold whole documents; shuffle files go when the statement that made them ends."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def digest(column: str = "text") -> Column:
    """16 bytes of the SHA-256 of a text: equal texts, and no others, have equal digests."""
    return F.unhex(F.substring(F.sha2(whole_text(column), 256), 1, 32))


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; rows without an id fall into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def likely_in(rows: DataFrame, marks: DataFrame, key: str, bits: int = 23) -> DataFrame:
    """The rows of ``rows`` whose ``key`` may be in ``marks``, and some others: before a semi join, so that most rows
    without a partner need not be shuffled. A bitmap of ``2^bits`` bits (1 MiB) is broadcast, a fixed size."""
    hash_ = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))  # never null, so no filter repeats the key
    word, bit = F.shiftright("_fl_hash", 6), F.expr("shiftleft(1L, cast(_fl_hash & 63 as int))")
    bitmap = marks.select(hash_.alias("_fl_hash")).groupBy(word.alias("_fl_word")).agg(F.bit_or(bit).alias("_fl_bits"))
    found = rows.withColumn("_fl_hash", hash_).withColumn("_fl_word", word).join(F.broadcast(bitmap), "_fl_word")
    return found.filter(F.col("_fl_bits").bitwiseAND(bit) != 0).select(*rows.columns)


# -- Arrow batches ---------------------------------------------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the UTF-8 bytes of ``column`` and the offsets of its rows."""
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(text):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        part = offsets[start : stop + 1]
        yield batch.slice(start, stop - start), raw[part[0] : part[-1]], part - part[0]
        start = stop


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item between consecutive offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_row(offsets: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of sorted positions ``at`` by the row they lie in."""
    return np.searchsorted(at, offsets)


# -- hashing ---------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def lower_bytes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case text; letters outside ASCII follow Unicode, so rows may change their length in bytes."""
    text = raw.tobytes().decode("utf-8", "replace")
    low = text.lower()
    data = np.frombuffer(low.encode("utf-8"), dtype=np.uint8)
    if len(data) == len(raw) and len(low) == len(text):
        return data, offsets
    rows = [raw[a:b].tobytes().decode("utf-8", "replace").lower().encode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(rows), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


_STEPS = np.arange(1, 65, dtype=np.uint64) * GOLD
_POWERS = mix(np.arange(1, 4097, dtype=np.uint64) * GOLD) | np.uint64(1)
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of letters, digits and non-ASCII characters), and the word offsets of rows."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    flag = inside[raw]
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] = flag[edges]
    last = flag.copy()
    last[:-1] &= ~flag[1:]
    last[edges - 1] = flag[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    at = np.arange(int(size.sum()))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    inner = at - np.repeat(begin, size)
    value = (raw[inner + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)) * _POWERS[inner & 4095]
    if size.max() > 4096:  # positions beyond the table: another power for each round through it
        value *= mix((inner >> 12).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * GOLD)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of each row, and their row offsets.

    A row with fewer words, but at least one, has one shingle: all its words.
    """
    count = np.diff(offsets)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(shingles)])
    start = np.arange(int(out[-1])) - np.repeat(out[:-1], shingles) + np.repeat(offsets[:-1], shingles)
    have = np.repeat(np.minimum(count, size), shingles)
    total = np.zeros(len(start), dtype=np.uint64)
    for j in range(size):
        use = j < have
        at = np.where(use, start + j, 0)
        part = mix(words[at] + _STEPS[j : j + 1]) if len(words) else total
        total += np.where(use, part, np.uint64(0))
    return mix(total), out


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on every Arrow batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)
