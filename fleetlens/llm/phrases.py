"""Fingerprints of documents by locally consistent parsing.

A text is a row of symbols, first its code points. One level of parsing joins runs of equal symbols, labels every symbol
by deterministic coin tossing (twice the lowest bit in which it differs from its left neighbour, plus that bit; three more
rounds on the labels leave values below six, and neighbours still differ), cuts the row before each local maximum of the
labels, and names every phrase by a hash of its symbols. Cuts depend on a few neighbours only, so equal substrings get
the same phrases inside whatever their offset. The names are the symbols of the next level.

The fingerprint holds, for levels 1 to ``LEVELS`` (about 3, 9 and 27 code points a phrase), the ``KEPT`` least hashes of
(name, occurrence). The likeness of two fingerprints compares the highest level at which both have enough phrases: the
estimated share of phrases they have in common (Dice coefficient, 0 to 1).
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import GOLD, map_batches, mix, query, slices, table, whole_text

LEVELS, KEPT = 3, 32
ENOUGH = 8
SYMBOLS = 1 << 20
_POWER = mix(np.arange(1, 4097, dtype=np.uint64) * GOLD) | np.uint64(1)
_SALTS = mix(np.arange(1, LEVELS + 1, dtype=np.uint64))


def coin_toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 128 (for 64-bit values); the first symbol of a row is compared with its own complement."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    differ = x ^ left
    low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    return low * np.uint64(2) + ((x >> low) & np.uint64(1))


def parse(symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases and their rows. Rows are sorted."""
    if not len(symbol):
        return symbol, row
    new = np.ones(len(symbol), dtype=bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(symbol)))
    symbol, row = symbol[at].copy(), row[at]
    long_ = run > 1
    symbol[long_] = mix(symbol[long_] ^ mix(run[long_].astype(np.uint64)))
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    begin = np.flatnonzero(first)
    label = symbol
    for _ in range(4):
        label = coin_toss(label, begin)
    cut = first.copy()
    cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[1:-1] & ~first[2:]
    start = np.flatnonzero(cut)
    inner = np.arange(len(symbol)) - np.repeat(start, np.diff(np.append(start, len(symbol))))
    name = np.add.reduceat(mix(symbol) * _POWER[inner & 4095], start)
    return mix(name), row[start]


def _least(name: np.ndarray, row: np.ndarray, rows: int, salt: np.ndarray) -> list[np.ndarray]:
    """The ``KEPT`` least 32-bit hashes of (name, occurrence) of each row, ascending. Repeated phrases count as often as
    they occur."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (name >> np.uint64(24)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    seen = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    row = (key >> np.uint64(40)).astype(np.int64)
    value = mix(((key & np.uint64((1 << 40) - 1)) ^ salt) + seen.astype(np.uint64) * GOLD) >> np.uint64(32)
    count = np.bincount(row, minlength=rows)
    # enough for KEPT values of a long row, with a margin of many deviations
    limit = np.where(count > 8 * KEPT, (4.0 * KEPT / np.maximum(count, 1)) * 2.0**32, 2.0**33)
    some = value < limit[row]
    least = np.sort((row[some].astype(np.uint64) << np.uint64(32)) | value[some])
    edges = np.searchsorted(least >> np.uint64(32), np.arange(rows + 1).astype(np.uint64))
    return [least[a : min(b, a + KEPT)].astype(np.uint32) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def sketches(texts: list[str]) -> list[list[np.ndarray]]:
    """For each text the least hashes of each level."""
    out: list[list[np.ndarray]] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SYMBOLS):
            size += len(texts[j])
            j += 1
        points = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        symbol, row, levels = mix(points + np.uint64(1)), np.repeat(np.arange(j - i), [len(t) for t in texts[i:j]]), []
        for level in range(LEVELS):
            symbol, row = parse(symbol, row)
            levels.append(_least(symbol, row, j - i, _SALTS[level : level + 1]))
        out += [list(x) for x in zip(*levels, strict=True)]
        i = j
    return out


def fingerprint(sketch: list[np.ndarray]) -> str:
    return ".".join(s.astype(">u4").tobytes().hex() for s in sketch)


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Estimated Dice coefficient of the phrases of two texts; 1 for two empty texts."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    level = max([i for i in range(LEVELS) if min(len(a[i]), len(b[i])) >= ENOUGH], default=0)
    x, y = a[level], b[level]
    both = np.union1d(x, y)
    if len(x) == KEPT or len(y) == KEPT:
        both = both[:KEPT]
    share = np.isin(both, np.intersect1d(x, y)).mean()
    return float(2 * share / (1 + share))


def document_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``fingerprint`` (its name must be free). Null texts have that of an empty text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
        return batch.append_column("fingerprint", pa.array([fingerprint(s) for s in sketches(texts)], pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, work, f"{fields}, fingerprint string")


def _below(boundaries: list[float], value: Column) -> Column:
    """How many of the sorted boundaries are at most ``value`` (0 for null): a search in two steps."""
    if not boundaries:
        return F.lit(0)
    step = max(1, int(len(boundaries) ** 0.5))
    literal = lambda x: F.from_json(F.lit(json.dumps(x)), "array<double>")
    coarse = F.size(F.filter(literal(boundaries[::step]), lambda x: x <= value))
    fine = F.slice(literal(boundaries), (coarse - 1) * step + 1, F.lit(step))
    return F.when(coarse > 0, (coarse - 1) * step + F.size(F.filter(fine, lambda x: x <= value))).otherwise(0)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows ``bucket``, ``doc_id``, ``text``, ``own``, partitioned by bucket and sorted, such that each own row is
    followed by the next document in the order of ids (after the last: the first).

    Ids are cut into buckets at approximate quantiles. The first rows of a bucket also go to the bucket before it, as
    rows that are not its own. There are four buckets for each of ``parts`` partitions, so that hashing deals them
    evenly. Only boundaries and one id per bucket reach the driver. Ties of ids are ordered by a
    hash of the text; null ids come first.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("x")).filter("x IS NOT NULL")
    cuts = 4 * parts
    quantiles = ids.approxQuantile("x", [i / cuts for i in range(1, cuts)], 0.25 / cuts)
    boundaries = sorted(set(quantiles))
    bucket = _below(boundaries, F.col("doc_id").cast("double")).cast("int")
    heads = docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("head"))
    heads = sorted(((r["bucket"], r["head"]["doc_id"]) for r in heads.collect()), key=lambda x: x[0])
    if not heads:
        return docs.select(F.lit(0).alias("bucket"), "doc_id", whole_text().alias("text"), F.lit(True).alias("own"))
    head, before = [None] * (len(boundaries) + 1), [-1] * (len(boundaries) + 1)
    for i, (b, first) in enumerate(heads):
        head[b], before[b] = first, heads[i - 1][0]
    at = lambda x, kind: F.element_at(F.from_json(F.lit(json.dumps(x)), f"array<{kind}>"), F.col("bucket") + 1)
    rows = docs.select("doc_id", whole_text().alias("text"), bucket.alias("bucket"))
    first = F.col("doc_id").eqNullSafe(at(head, "bigint"))
    own = F.struct("bucket", F.lit(True).alias("own"), F.lit(0).alias("late"))
    copy = F.struct(at(before, "int").alias("bucket"), F.lit(False).alias("own"), F.lit(1).alias("late"))
    places = F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own)))
    rows = rows.select("doc_id", "text", places.alias("p")).select("p.*", "doc_id", "text")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "late", "doc_id", F.xxhash64("text")).drop("late")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: ``n_chars``, the SHA-256 of its edited text, both fingerprints, and the
    likeness to the edited text's and to the next document's. The edited text has its last quarter (rounded down)
    replaced by as many first code points of the next document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        waiting = None  # (bucket, doc_id, text, sketch) of an own row whose next document has not been seen
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = sketches(texts)
                pairs = []
                for b, own, name, text, sketch in zip(part.column("bucket").to_pylist(), part.column("own").to_pylist(), part.column("doc_id").to_pylist(), texts, found, strict=True):
                    if waiting is not None and waiting[0] == b:
                        pairs.append((*waiting[1:], text, sketch))
                        waiting = None
                    if own:
                        waiting = (b, name, text, sketch)
                if not pairs:
                    continue
                cut = [len(text) // 4 for _, text, _, _, _ in pairs]
                edited = [text[: len(text) - q] + after[:q] for q, (_, text, _, after, _) in zip(cut, pairs, strict=True)]
                marks = sketches(edited)
                columns = [
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([len(p[1]) for p in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
                    pa.array([fingerprint(p[2]) for p in pairs]),
                    pa.array([fingerprint(m) for m in marks]),
                    pa.array([likeness(p[2], m) for p, m in zip(pairs, marks, strict=True)], pa.float64()),
                    pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return with_next(docs.select("doc_id", "text"), parts).mapInArrow(run, schema)


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
