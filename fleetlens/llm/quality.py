"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

Statistics of a whole text (shares of character classes, word and line lengths, repetition, entropy) are standardised
with means and deviations over all documents. Random cosine features approximate a Gaussian kernel over them. Each
partition sums its normal equations, the sums meet in one small system, and isotonic regression over a histogram of the
raw scores of the training rows turns scores into probabilities.

Everything that leaves the executors has a fixed size: two moments per statistic, one symmetric matrix of
``FEATURES + 1`` rows, and ``BINS`` counts. All labelled training rows take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import cut_lineage, fold, hash_spans, map_batches, query, slices, table, whole_text, word_spans

FEATURES = 192
RIDGE = 1e-3
BINS = 256
#: Bytes of text looked at at once; bounds the memory of a task.
SLICE = 1 << 20
#: Width of the kernel in standardised statistics, as a multiple of the square root of their number.
WIDTH = 1.0
KEEP = 0.7

# byte classes
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, OTHER, WIDE = range(8)
CLASS = np.full(256, OTHER, dtype=np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = LOWER, UPPER, DIGIT, WIDE
CLASS[[32, 9, 13]], CLASS[10], CLASS[[44, 46, 39, 45]] = SPACE, LINE, STOP

STATISTICS = (
    "size", "lower", "upper", "digit", "space", "stop", "other", "wide", "word_length", "words_per_line", "stops_per_word",
    "capital_starts", "other_after_letter", "distinct_words", "top_word", "distinct_lines", "top_line", "entropy",
)


def _repeats(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the number of different hashes and the count of the most frequent one."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    distinct = np.bincount(r[first], minlength=len(offsets) - 1)
    most = np.zeros(len(offsets) - 1)
    np.maximum.at(most, r[first], np.diff(np.append(first, len(h))).astype(float))
    return distinct, most


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text; zeros for an empty one."""
    docs, size = len(offsets) - 1, np.diff(offsets)
    rows = np.repeat(np.arange(docs), size)
    kind = CLASS[raw]
    count = np.bincount(rows * 8 + kind, minlength=docs * 8).reshape(docs, 8).astype(float)
    step = kind[:-1] * 8 + kind[1:]
    inner = rows[:-1] == rows[1:]
    moves = np.bincount((rows[:-1] * 64 + step)[inner], minlength=docs * 64).reshape(docs, 8, 8).astype(float)
    letters = [LOWER, UPPER, WIDE]
    bytes_ = np.bincount(rows * 256 + raw, minlength=docs * 256).reshape(docs, 256).astype(float)
    n = np.maximum(size, 1).astype(float)
    share = bytes_ / n[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    starts, ends, at = word_spans(raw, offsets)
    words = np.diff(at)
    w = np.maximum(words, 1).astype(float)
    distinct, top = _repeats(hash_spans(raw, starts, ends), at)
    visible = np.ones(256, dtype=bool)
    visible[10] = False
    lstarts, lends, lat = word_spans(raw, offsets, visible)
    lines = np.maximum(np.diff(lat), 1).astype(float)
    ldistinct, ltop = _repeats(hash_spans(raw, lstarts, lends), lat)
    capitals = moves[:, [SPACE, LINE], UPPER].sum(axis=1)
    out = np.column_stack([
        np.log1p(size), *(count[:, c] / n for c in (LOWER, UPPER, DIGIT, SPACE, STOP, OTHER, WIDE)),
        np.log1p(count[:, letters].sum(axis=1) / w), np.log1p(w / lines), count[:, STOP] / w, capitals / w,
        moves[:, letters, OTHER].sum(axis=1) / w, np.log(w) - np.log(np.maximum(distinct, 1)), top / w,
        np.log(lines) - np.log(np.maximum(ldistinct, 1)), ltop / lines, entropy,
    ])
    return np.where(size[:, None] > 0, out, 0.0)


def document_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and an array ``x`` with the statistics of ``text``."""
    width = len(STATISTICS)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([statistics(raw, offsets) for _, raw, offsets in slices(batch, "text", SLICE)])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.reshape(-1)))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], [*keep, "x"])

    return map_batches(docs.select(*keep, whole_text().alias("text")), work, f"{kept}, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Kernel:
    """Standardisation and the random cosine features."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        rng = np.random.default_rng(11)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([wave, np.ones(len(x))])


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over ``rows(x, y)``. Each partition returns one sum; equal cells meet in a shuffle."""
    d = len(kernel.phase) + 1
    cells = np.triu_indices(d)

    def run(batches):
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                z = kernel(_matrix(batch))
                a += z.T @ z
                b += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
        value = np.concatenate([a[cells], b])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], ["cell", "value"])

    sums = rows.mapInArrow(run, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    value = np.zeros(len(cells[0]) + d)
    value[sums["cell"].to_numpy()] = sums["value"].to_numpy()
    a = np.zeros((d, d))
    a[cells] = value[: len(cells[0])]
    return a + np.triu(a, 1).T, value[len(cells[0]) :]


def isotonic(at: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: positions and non-decreasing shares."""
    blocks: list[list[float]] = []
    for x, g, n in zip(at, good, total, strict=True):
        blocks.append([x * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Quality:
    """A fitted model; ``score`` maps statistics to probabilities. Without training rows every score is 0.5."""

    def __init__(self, kernel: Kernel, weights: np.ndarray | None, steps: tuple[np.ndarray, np.ndarray] | None):
        self.kernel, self.weights, self.steps = kernel, weights, steps

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.kernel(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), *self.steps)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.minimum(((raw + 0.5) / 2 * BINS).astype(np.int64), BINS - 1)


def fit(stats: DataFrame, labelled: DataFrame) -> Quality:
    """``stats`` gives the moments (all documents), ``labelled(x, y)`` the training rows."""
    width = len(STATISTICS)
    moments = stats.select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    mean, deviation = (np.array([moments[f"{c}{i}"] or 0.0 for i in range(width)]) for c in "ms")
    kernel = Kernel(mean, deviation)
    a, b = normal_equations(labelled, kernel)
    rows = a[-1, -1]  # the constant feature counts them
    if rows == 0:
        return Quality(kernel, None, None)
    model = Quality(kernel, np.linalg.solve(a + RIDGE * rows * np.diag([1.0] * (len(a) - 1) + [1e-6]), b), None)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = model.raw(_matrix(batch))
        return pa.RecordBatch.from_arrays([pa.array(_bin(raw)), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    bins = map_batches(labelled, work, "bin bigint, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("at"), F.sum("y").alias("good"), F.count("y").alias("n")).orderBy("bin").toPandas()
    model.steps = isotonic(bins["at"].to_numpy(), bins["good"].to_numpy(), bins["n"].to_numpy(dtype=float))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Labels are learned from rows whose fold (crc32 of the id, modulo 4) is not 2, from ``labels(doc_id, quality)``;
    null labels and ids without text rows teach nothing, and of several labels of one id the least counts. Equal texts
    get equal scores. A null text is scored as an empty one. Without any training row all scores are 0.5.
    """
    stats = cut_lineage(document_statistics(docs.select("doc_id", "text"), ["doc_id"]), "statistics")
    marks = labels.filter(F.col("quality").isNotNull() & (fold(4) != 2)).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    model = fit(stats, stats.join(marks, "doc_id").select("x", "y"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(_matrix(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(stats.select("doc_id", "x"), work, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all columns. The model is applied to each text where it stands, so
    rows are neither joined nor moved."""
    stats = cut_lineage(document_statistics(docs.select("doc_id", "text"), ["doc_id"]), "statistics")
    marks = labels.filter(F.col("quality").isNotNull() & (fold(4) != 2)).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    model = fit(stats, stats.join(marks, "doc_id").select("x", "y"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([statistics(raw, offsets) for _, raw, offsets in slices(batch, "text", SLICE)])
        return batch.filter(pa.array(model.score(x) >= KEEP))

    return docs.mapInArrow(lambda batches: (work(b) for b in batches if b.num_rows), docs.schema)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
