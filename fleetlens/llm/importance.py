"""Importance resampling towards a target: weights by arrays of gains, and an exact cutoff by weighted medians.

Features of a text are its runs of 1 to ``N`` consecutive words, hashed into ``BUCKETS`` buckets. The counts of the buckets
over all documents and over all target texts give each bucket a gain, the logarithm of its ratio; the weight of a
document is the mean gain of its features, looked up in one array. With a Gumbel number from a hash of the id added to
the weight, the highest scores are a draw without replacement in proportion to the exponentials of the weights.

The cutoff of the draw is found without a sort of all documents: every partition tells the median of its remaining keys
and how many remain; the median of these medians, weighted by the remaining numbers, has at least a quarter of all
remaining keys on either side, so each round discards at least that share. Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD_BYTES, cut_lineage, map_batches, query, row_of, slices, table, whole_text, word_spans
from fleetlens.operators.sequencing import number_rows

N, BUCKETS, SEED = 1, 10_000, 2024
SHARE_PERCENT, LEAST_WORDS = 10, 20
#: Spans up to this many bytes are hashed side by side.
WIDE = 48
#: Remaining keys are written anew when fewer than this share of the last written ones remain.
SHRINK = 8

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def crc32_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each span of bytes."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    length = size[order]
    state = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    longest = int(np.searchsorted(-length, -WIDE))  # spans beyond WIDE, if any, come first
    first = starts[order]
    for j in range(int(length[longest]) if longest < len(length) else 0):
        n = int(np.searchsorted(-length, -j))  # spans longer than j
        part = slice(longest, n)
        state[part] = _CRC[(state[part] ^ raw[first[part] + j]) & 0xFF] ^ (state[part] >> 8)
    out = np.empty(len(size), dtype=np.int64)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[:longest]:
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    return out


def feature_buckets(raw: np.ndarray, offsets: np.ndarray, n: int = N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature, the feature offsets of the rows, and the number of words of each row.

    Words are runs of ASCII digits, letters (A-Z in lower case) and all characters from U+0080."""
    low = _LOWER[raw]
    starts, ends, at = word_spans(low, offsets, WORD_BYTES)
    words = np.diff(at)
    if n == 1:
        return crc32_spans(low, starts, ends) % buckets, at, words
    # the words of a row joined by one space; a feature is a span of that text
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 32, dtype=np.uint8)
    inner = np.arange(len(joined)) - np.repeat(begin, size)
    letter = inner < np.repeat(size - 1, size)
    joined[letter] = low[(inner + np.repeat(starts, size))[letter]]
    last = np.repeat(at[1:], words)
    found = []
    for k in range(n):
        i = np.flatnonzero(np.arange(len(starts)) + k < last)
        found.append((i, crc32_spans(joined, begin[i], begin[i + k] + size[i + k] - 1) % buckets))
    word = np.concatenate([i for i, _ in found])
    order = np.argsort(word, kind="stable")
    return np.concatenate([b for _, b in found])[order], np.searchsorted(word[order], at), words


def bucket_counts(rows: DataFrame, text: str = "text", n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts. Counts are summed per partition first; one number a bucket is collected."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, raw, offsets in slices(batch, "text"):
                total += np.bincount(feature_buckets(raw, offsets, n, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counts = rows.select(whole_text(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    total_s, total_t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * total_s / ((s + 1.0) * total_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def gumbel(id: int | None, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)) for a number u between 0 and 1 from the hash of the id; no id is hashed as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int = N, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``words``, ``n_features``, ``weight``, ``score`` of every row of ``docs(doc_id, text)``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, features, weights = [], [], []
        for _, raw, offsets in slices(batch, "text"):
            bucket, at, count = feature_buckets(raw, offsets, n, len(gain))
            features.append(np.diff(at))
            words.append(count)
            total = np.bincount(row_of(at), weights=gain[bucket].astype(np.float64), minlength=len(at) - 1)  # whole numbers below 2^53
            weights.append(total.astype(np.int64) // np.maximum(features[-1], 1))
        weight = np.concatenate(weights)
        score = weight + np.array([gumbel(x, seed) for x in batch.column("doc_id").to_pylist()], dtype=np.int64)
        values = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (np.concatenate(words), np.concatenate(features), weight, score))]
        return pa.RecordBatch.from_arrays(values, ["doc_id", "words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return map_batches(rows, work, "doc_id bigint, words bigint, n_features bigint, weight bigint, score bigint")


# -- the exact cutoff ------------------------------------------------------------------------------------------------

Key = tuple[int, int]


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The key at which half of the total weight of sorted (key, weight) is reached."""
    half, seen = sum(w for _, w in medians) / 2, 0
    for key, weight in sorted(medians):
        seen += weight
        if seen >= half:
            return key
    raise ValueError("no keys")


def _sides(pivot: Key | None) -> Callable:
    """For one partition of keys: how many are below, at and above the pivot, and the medians of both sides."""

    def run(batches):
        parts = [np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]) for batch in batches]
        x, y = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        if pivot is None:
            lo = hi = 0
        else:
            a, b = np.searchsorted(x, pivot[0]), np.searchsorted(x, pivot[0], side="right")
            lo, hi = (int(a + np.searchsorted(y[a:b], pivot[1], side=side)) for side in ("left", "right"))
        row = {"below": [lo], "at": [hi - lo], "above": [len(x) - hi]}
        for side, (i, j) in {"below": (0, lo), "above": (hi, len(x))}.items():
            middle = (i + j - 1) // 2
            row[f"{side}_x"], row[f"{side}_y"] = ([int(x[middle])], [int(y[middle])]) if j > i else ([None], [None])
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([(c, pa.int64()) for c in _SIDES]))

    return run


_SIDES = ("below", "at", "above", "below_x", "below_y", "above_x", "above_y")


def cutoff(keys: DataFrame, k: int) -> Key | None:
    """The ``k``-th least key of ``keys(x, y)`` (longs, not null), counted from 1; None if ``k`` is below 1.

    One row per partition reaches the driver in each round, with the median of the keys that remain there and their
    number. Keys that remain are written anew when they are an eighth of the last written ones, so later rounds read less.
    """
    if k < 1:
        return None
    keys = cut_lineage(keys.select("x", "y"), "keys")
    low: Key | None = None
    high: Key | None = None
    pivot: Key | None = None
    left, written = k, None
    while True:
        inside = (F.lit(True) if low is None else _after(low)) & (F.lit(True) if high is None else _before(high))
        rows = keys.filter(inside).mapInArrow(_sides(pivot), ", ".join(f"{c} bigint" for c in _SIDES)).filter("below + at + above > 0").collect()
        below, at, above = (sum(r[c] for r in rows) for c in ("below", "at", "above"))
        if left > below + at + above:
            raise ValueError(f"{k} keys were asked for")
        if below < left <= below + at:
            return pivot
        side = "below" if left <= below else "above"
        if pivot is not None:
            low, high = (low, pivot) if side == "below" else (pivot, high)
            left -= 0 if side == "below" else below + at
        remaining = below if side == "below" else above
        written = written or remaining
        if remaining * SHRINK <= written:
            inside = (F.lit(True) if low is None else _after(low)) & (F.lit(True) if high is None else _before(high))
            keys, written = cut_lineage(keys.filter(inside), "keys"), remaining
        pivot = weighted_median([((r[f"{side}_x"], r[f"{side}_y"]), r[side]) for r in rows if r[side]])


def _before(key: Key) -> Column:
    return (F.col("x") < key[0]) | ((F.col("x") == key[0]) & (F.col("y") < key[1]))


def _after(key: Key) -> Column:
    return (F.col("x") > key[0]) | ((F.col("x") == key[0]) & (F.col("y") > key[1]))


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, share_percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` of every row of ``docs(doc_id, text)``, towards
    ``target(text)``; other columns are ignored.

    Of the documents with at least ``least_words`` words the share with the highest scores (ties: the smaller id; a null
    id is the least) is drawn and ranked from 1, others have a null rank. Null and empty texts have no feature, a weight of
    0 and are never drawn. Repeated rows are documents of their own; rows alike in id and score get ranks in any order.
    An empty target leaves the smoothed gains. An empty table of documents gives an empty result.
    """
    counts = [bucket_counts(rows, "text", n, buckets) for rows in (docs, target)]
    everything = cut_lineage(scored(docs, gains(*counts), n, seed), "scores")
    least_id = F.lit(-(2**63)).cast("bigint")
    keyed = everything.withColumns({"x": -F.col("score"), "y": F.coalesce("doc_id", least_id)})
    able = F.col("words") >= least_words
    wanted = everything.filter(able).count() * share_percent // 100
    last = cutoff(keyed.filter(able), wanted)
    rest = F.lit(None).cast("bigint").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return everything.select(*columns, rest)
    drawn = able & ~_after(last)
    ranked = number_rows(keyed.filter(drawn).withColumn("all", F.lit(1)), "all", ["x", "y"])
    out = ranked.select(*columns, F.when(F.col("seq") <= wanted, F.col("seq")).alias("rank"))  # the last key may stand in several rows
    return out.unionByName(keyed.filter(~drawn).select(*columns, rest))


_SQL = r"""
WITH RECURSIVE steps AS (SELECT range AS i, range::BIGINT AS c, 0 AS n FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
names AS (SELECT DISTINCT word FROM words),
bytes AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda j: ('0x' || substr(hex(encode(word)), 2 * j + 1, 2))::BIGINT) AS b FROM names),
buckets AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
features AS (SELECT side, id, bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY ALL),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 't'), 0)::BIGINT AS t FROM features GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS big_s, sum(t)::DOUBLE AS big_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 's' GROUP BY id),
scores AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scores LEFT JOIN able USING (doc_id)
"""


@query("op11_importance", _SQL)
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark texts, its score, and its rank in a tenth drawn by them."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
