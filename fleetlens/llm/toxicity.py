"""Toxicity scores by class-conditional Kneser-Ney models of the letters of words.

Text becomes words over 31 symbols: 26 letters (case folded) and five for the bytes of other letters; anything else
ends a word, and the end is a symbol of its own. A model gives the probability of each symbol after the whole beginning
of its word, so a rare expression is scored as a whole and related forms share its beginning. For each class (toxic,
ordinary) it interpolates, with absolute discounts, the counts of that class with a backoff model that both classes
share: Kneser-Ney continuation counts over the last symbols, taken from the texts of both classes. What neither class
has seen gets the same backoff probability in both and hardly sways the result.

Counts come from all labelled training texts and are summed in Spark, each beginning of a word under its own 64-bit key
beside that of the beginning before it. Ratios are worked out there by joins and stay in a table that grows with the
words of the corpus. Scoring joins the different words of the texts to that table, once each; the beginnings of up to
``HEAD`` symbols, at most ``32^HEAD``, are sent to the tasks instead. The words found in most texts (at most ``COMMON``)
are sent with their ratios, so their occurrences need no shuffle; all others are joined to their texts.

Every word counts once per text, in training and in scoring, so a word repeated through one document weighs no more
than any other. The ratios are normalised by length in two ways: their mean over the words of a text, and the part of
them above ``CLEAR`` over the root of the number of words, where a few expressions show in a long text. A logistic curve
over these is fitted to grouped training rows of a calibration fold, whose texts the counts for that step leave out; the
final counts use all training folds.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import cut_lineage, fold, map_batches, mix, query, slices, table, whole_text

BITS = 5
SHARED = 4
#: Beginnings up to this length are looked up by their symbols; below ``SHARED``, so the symbols tell the length.
HEAD = 3
#: Words whose ratio is sent to every task; the others are joined.
COMMON = 1 << 17
#: Ratios of words are whole multiples of 1 / UNIT, so sums do not depend on their order.
UNIT = 1 << 20
DISCOUNT = 0.9
#: A word whose ratio is below this says nothing by itself; above, at most ``MOST`` more counts.
CLEAR, MOST = 3.5, 3.0
#: Bytes of text walked at once, and codes a task holds before it sends them: both bound its memory.
SLICE, HELD = 1 << 20, 400_000
#: Bits of the filter that keeps texts without a label out of the join.
FILTER_BITS = 23

SYMBOL = np.zeros(256, dtype=np.uint8)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[192:256] = 27
SYMBOL[128:192] = 28 + np.arange(64) % 4  # upper and lower case differ by 32 in the last byte
#: For each symbol a byte that stands for it.
BYTE = np.array([0, *range(97, 123), 192, 128, 129, 130, 131], dtype=np.uint8)
_POWER = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


class Walk:
    """The symbols of a slice of texts, word by word: ``key`` of the beginning up to each symbol, ``before`` that of the
    beginning without it (0 if empty), ``low`` the code of the last ``SHARED`` symbols, and where words and rows start."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        docs, size = len(offsets) - 1, np.diff(offsets)
        # a separator after every text, so no word crosses rows
        spaced = np.zeros(len(raw) + docs, dtype=np.uint8)
        place = np.arange(len(raw)) + np.repeat(np.arange(docs), size)
        spaced[place] = SYMBOL[raw]
        rows = np.repeat(np.arange(docs), size + 1)
        keep = np.ones(len(spaced), dtype=bool)  # the end of a word is its first separator; drop the others
        if len(keep):
            keep[1:] = (spaced[1:] > 0) | (spaced[:-1] > 0)
            keep[0] = spaced[0] > 0
        s, self.rows = spaced[keep].astype(np.int64), rows[keep]
        first = np.ones(len(s), dtype=bool)
        first[1:] = s[:-1] == 0
        self.starts = np.flatnonzero(first)
        length = np.diff(np.append(self.starts, len(s)))
        inner = np.arange(len(s)) - np.repeat(self.starts, length)
        part = (s + 1).astype(np.uint64) * _POWER[np.minimum(inner, 1023)]
        total = np.cumsum(part, dtype=np.uint64)
        base = np.repeat(total[self.starts] - part[self.starts], length)
        self.key = mix(total - base).view(np.int64)
        self.before = np.zeros_like(self.key)
        self.before[1:] = self.key[:-1]
        self.before[self.starts] = 0
        low = s.copy()
        for back in range(1, SHARED):
            earlier = np.zeros_like(s)
            earlier[back:] = s[:-back] if back < len(s) else s[:0]
            earlier[inner < back] = 0
            low |= earlier << (BITS * back)
        self.low, self.docs = low, docs
        self._once()

    def _once(self) -> None:
        """Keep the first occurrence of each word of a row."""
        if not len(self.starts):
            return
        length = np.diff(np.append(self.starts, len(self.key)))
        word, row = self.key[self.starts + length - 1], self.rows[self.starts]
        order = np.lexsort((word, row))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
        first = np.zeros(len(order), dtype=bool)
        first[order[new]] = True
        keep = np.repeat(first, length)
        self.key, self.before, self.low, self.rows = self.key[keep], self.before[keep], self.low[keep], self.rows[keep]
        self.starts = np.cumsum(length[first]) - length[first]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The key, the length (with the end) and the row of each word."""
        length = np.diff(np.append(self.starts, len(self.key)))
        return self.key[self.starts + length - 1], length, self.rows[self.starts]


Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _summed(key: np.ndarray, before: np.ndarray, low: np.ndarray, old: Sums | None) -> Sums:
    """Keys with what belongs to them and how often they occur, added to ``old``."""
    keys, at, n = np.unique(key, return_index=True, return_counts=True)
    new = keys, before[at], low[at], n
    if old is None:
        return new
    keys, at, back = np.unique(np.concatenate([old[0], keys]), return_index=True, return_inverse=True)
    before, low = (np.concatenate([x, y])[at] for x, y in zip(old[1:3], new[1:3], strict=True))
    return keys, before, low, np.bincount(back, weights=np.concatenate([old[3], n]), minlength=len(keys)).astype(np.int64)


KINDS = ("plain", "toxic", "plain_late", "toxic_late")


def counts(rows: DataFrame) -> DataFrame:
    """``key``, ``before``, ``low`` and the number of texts of each of ``KINDS`` that have a beginning of a word.

    ``rows(text, kind)``; ``key`` is that of the beginning, ``before`` that of the beginning without its last symbol,
    ``low`` holds its last symbols. Tasks sum up to ``HELD`` keys before they send them.
    """

    def batch_of(kind: int, found: Sums) -> pa.RecordBatch:
        zero = pa.array(np.zeros(len(found[0]), np.int64))
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in found[:3]), *(pa.array(found[3]) if k == kind else zero for k in range(4))], ["key", "before", "low", *KINDS])

    def run(batches):
        sums: dict[int, tuple] = {}
        for batch in batches:
            for part, raw, offsets in slices(batch, "text", SLICE):
                walk = Walk(raw, offsets)
                kinds = part.column("kind").to_numpy(zero_copy_only=False)[walk.rows]
                for kind in np.unique(kinds):
                    of = kinds == kind
                    sums[kind] = _summed(walk.key[of], walk.before[of], walk.low[of], sums.get(kind))
                    if len(sums[kind][0]) > HELD:
                        yield batch_of(kind, sums.pop(kind))
        for kind, found in sums.items():
            yield batch_of(kind, found)

    found = rows.select("text", "kind").mapInArrow(run, "key bigint, before bigint, low bigint, " + ", ".join(f"{c} bigint" for c in KINDS))
    return found.groupBy("key", "before", "low").agg(*[F.sum(c).alias(c) for c in KINDS])


def _kneser_ney(code: np.ndarray, count: np.ndarray, lower: np.ndarray, order: int) -> np.ndarray:
    """Interpolated probabilities of all codes of ``order``, given those of the order below."""
    history, size = code >> BITS, 1 << (BITS * (order - 1))
    total, kinds = np.bincount(history, weights=count, minlength=size), np.bincount(history, minlength=size)
    weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    suffixes = len(lower) >> BITS
    out = (weight.reshape(-1, suffixes, 1) * lower.reshape(1, suffixes, 1 << BITS)).reshape(-1)
    out[code] += (count - DISCOUNT) / total[history]
    return out


def _backoff(code: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The shared model: probabilities of the last symbol of every code of ``SHARED`` symbols, from the number of
    different beginnings it ends."""
    lower, chain = np.full(1 << BITS, 2.0**-BITS), {SHARED: code}
    for order in range(SHARED - 1, 0, -1):
        chain[order] = np.unique(chain[order + 1] & ((1 << BITS * order) - 1))
    for order in range(1, SHARED):
        lower = _kneser_ney(*np.unique(chain[order + 1] & ((1 << BITS * order) - 1), return_counts=True), lower, order)
    return _kneser_ney(code, kinds, lower, SHARED)


class Model(NamedTuple):
    """``table(key, ratio, behind)`` of the beginnings longer than ``HEAD``: the log-likelihood ratio of the last symbol,
    and that of the backoff weights behind the beginning. ``ratio`` (nan where no text has it) and ``behind`` hold the
    same of the shorter ones, by their symbols; the empty beginning is 0."""

    table: DataFrame
    ratio: np.ndarray
    behind: np.ndarray


def ratio_model(found: DataFrame, late: bool) -> Model | None:
    """The ratios of the beginnings in ``counts``, with or without the calibration fold; None if a class has no words.
    At most one row per backoff code and per short beginning reaches the driver."""
    toxic, plain = (F.col(k) + F.col(f"{k}_late") if late else F.col(k) for k in ("toxic", "plain"))
    found = found.select("key", "before", "low", toxic.alias("toxic"), plain.alias("plain")).filter("toxic + plain > 0")
    if not all(found.agg(F.max(F.col("toxic") > 0), F.max(F.col("plain") > 0)).first()):
        return None
    low = found.groupBy("low").agg(F.count("*").alias("n")).orderBy("low").toArrow()
    shared = found.sparkSession.sparkContext.broadcast(_backoff(low.column("low").to_numpy(), low.column("n").to_numpy().astype(float)))
    sums = [f(c).cast("double").alias(f"{name}_{c}") for c in ("toxic", "plain") for name, f in (("total", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))]
    after = cut_lineage(found.groupBy("before").agg(*sums), "histories")

    def weight(y: str):
        return F.when(F.col(f"total_{y}") > 0, F.least(DISCOUNT * F.col(f"kinds_{y}") / F.col(f"total_{y}"), F.lit(1.0))).otherwise(1.0)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        ratio = np.zeros(batch.num_rows)
        for sign, y in ((1, "toxic"), (-1, "plain")):
            ratio += sign * np.log(np.maximum(c[y] - DISCOUNT, 0) / np.maximum(c[f"total_{y}"], 1) + c[f"weight_{y}"] * shared.value[c["low"]])
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("low"), pa.array(ratio)], ["key", "low", "ratio"])

    seen = found.join(after.select("before", "total_toxic", "total_plain", weight("toxic").alias("weight_toxic"), weight("plain").alias("weight_plain")), "before")
    behind = after.select(F.col("before").alias("key"), (F.log(weight("toxic")) - F.log(weight("plain"))).alias("behind"))
    seen = map_batches(seen.drop("before"), work, "key bigint, low bigint, ratio double").join(behind, "key", "left")
    seen = cut_lineage(seen.select("key", "low", "ratio", F.coalesce("behind", F.lit(0.0)).alias("behind")), "ratios")
    short = 1 << (BITS * HEAD)
    head = seen.filter(F.col("low") < short).toArrow()
    ratios, behinds, at = np.full(short, np.nan), np.zeros(short), head.column("low").to_numpy()
    ratios[at], behinds[at] = head.column("ratio").to_numpy(), head.column("behind").to_numpy()
    behinds[0] = behind.filter("key = 0").first().behind
    return Model(seen.filter(F.col("low") >= short).select("key", "ratio", "behind"), ratios, behinds)


def vocabulary(docs: DataFrame) -> DataFrame:
    """The different words of ``docs(text)``: ``word``, its ``letters`` and ``n``, in how many texts it occurs."""

    def run(batches):
        known, n, letters = np.empty(0, np.int64), np.empty(0, np.int64), []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(known), pa.concat_arrays(letters), pa.array(n)], ["word", "letters", "n"])

        for batch in batches:
            for _, raw, offsets in slices(batch, "text", SLICE):
                walk = Walk(raw, offsets)
                if not len(walk.starts):
                    continue
                word, length, _ = walk.words()
                keys, first, times = np.unique(word, return_index=True, return_counts=True)
                order = np.argsort(known)
                at = np.minimum(np.searchsorted(known, keys, sorter=order), max(len(known) - 1, 0))
                old = known[order[at]] == keys if len(known) else np.zeros(len(keys), bool)
                n[order[at[old]]] += times[old]
                new = first[~old]
                size = length[new] - 1
                place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(walk.starts[new], size)
                data = BYTE[walk.low[place] & ((1 << BITS) - 1)]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                letters.append(pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
                known, n = np.concatenate([known, keys[~old]]), np.concatenate([n, times[~old]])
                if len(known) > HELD:
                    yield rows()
                    known, n, letters = np.empty(0, np.int64), np.empty(0, np.int64), []
        if len(known):
            yield rows()

    return docs.select("text").mapInArrow(run, "word bigint, letters binary, n bigint").groupBy("word", "letters").agg(F.sum("n").alias("n"))


def word_ratios(words: DataFrame, model: Model) -> DataFrame:
    """``word``, ``n`` and ``ratio`` of every word, in units of 1 / ``UNIT``: the ratios of its beginnings as far as they
    are known, and what is behind the last known one unless that is the whole word."""
    sent = words.sparkSession.sparkContext.broadcast((model.ratio, model.behind))

    def run(batches):
        for batch in batches:
            letters, word, n = batch.column("letters").cast(pa.large_binary()), batch.column("word").to_numpy(), batch.column("n").to_numpy()
            ends = np.frombuffer(letters.buffers()[1], dtype=np.int64)[letters.offset : letters.offset + len(letters) + 1]
            raw = np.frombuffer(letters.buffers()[2], dtype=np.uint8)
            lo = 0
            while lo < len(word):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, side="right")) - 1)
                yield of_words(Walk(raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]), word[lo:hi], n[lo:hi])
                lo = hi

    def of_words(walk: Walk, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ratio, behind = sent.value
        _, length, _ = walk.words()
        total, last, going = np.zeros(len(word)), np.full(len(word), behind[0]), np.ones(len(word), dtype=bool)
        for i in range(HEAD):
            use = np.flatnonzero(going & (length > i))
            low = walk.low[walk.starts[use] + i]
            going[use] = known = ~np.isnan(ratio[low])
            total[use[known]] += ratio[low[known]]
            last[use[known]] = np.where(length[use[known]] == i + 1, 0, behind[low[known]])
        # one row with the sum so far for each word, and one for each longer beginning
        rest = np.where(going, np.maximum(length - HEAD, 0), 0)
        of = np.repeat(np.arange(len(word)), rest)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(rest) - rest, rest) + HEAD
        none = np.zeros(len(of))
        columns = {
            "word": np.concatenate([word, word[of]]), "n": np.concatenate([n, none.astype(np.int64)]), "at": np.concatenate([np.zeros(len(word), np.int64), inner]),
            "key": np.concatenate([word, walk.key[walk.starts[of] + inner]]), "sum": np.concatenate([total, none]), "last": np.concatenate([last, none]),
        }
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))

    parts = words.mapInArrow(run, "word bigint, n bigint, at bigint, key bigint, sum double, last double").join(model.table, "key", "left")
    own = F.col("at") == 0
    parts = parts.filter(own | F.col("ratio").isNotNull())
    total = F.sum(F.when(own, F.col("sum")).otherwise(F.col("ratio"))) + F.max_by(F.when(own, F.col("last")).otherwise(F.col("behind")), "at")
    return parts.groupBy("word").agg(F.max("n").alias("n"), F.round(total * UNIT).cast("bigint").alias("ratio"))


def common_words(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words of the most texts, sorted, and their ratios: as many as ``COMMON`` allows."""
    level = F.floor(F.log2("n") * 8)
    least, many = None, 0
    for r in ratios.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        many += r.words
        if many > COMMON:
            break
        least = r.level
    found = ratios.filter(level >= least).toArrow() if least is not None else None
    if found is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(found.column("word").to_numpy())
    return found.column("word").to_numpy()[order], found.column("ratio").to_numpy()[order]


NAMES = ("mean", "clear", "words")


def logistic(x: np.ndarray, good: np.ndarray, total: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic curve over grouped rows (Newton steps with a small penalty)."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([0.02] * x.shape[1] + [1e-4])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (total * p * (1 - p))[:, None]) + penalty, z.T @ (good - total * p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _with_features(docs: DataFrame, keep: str, model: Model) -> DataFrame:
    """For every row of ``docs(keep, text)`` the mean ratio of its words, their excess over ``CLEAR`` by the root of
    their number, and the log of that number; zeros for a text without words."""
    ratios = cut_lineage(word_ratios(vocabulary(docs), model), "words")
    sent = docs.sparkSession.sparkContext.broadcast(common_words(ratios))
    kind = docs.schema[keep].dataType.simpleString()
    lowest, most = round(CLEAR * UNIT), round(MOST * UNIT)

    def run(batches):
        common, ratio = sent.value
        done = TaskContext.get().partitionId() << 36  # a number for every row
        for batch in batches:
            for part, raw, offsets in slices(batch, "text", SLICE):
                walk = Walk(raw, offsets)
                word, _, row = walk.words() if len(walk.starts) else (np.empty(0, np.int64),) * 3
                at = np.minimum(np.searchsorted(common, word), max(len(common) - 1, 0))
                here = common[at] == word if len(common) else np.zeros(len(word), dtype=bool)
                known = ratio[at[here]]
                rows, n = np.arange(walk.docs) + done, np.bincount(row, minlength=walk.docs)
                sums = [np.zeros(walk.docs, np.int64), np.zeros(walk.docs, np.int64)]
                np.add.at(sums[0], row[here], known)
                np.add.at(sums[1], row[here], np.clip(known - lowest, 0, most))
                # one row for each text, under a key of its own, and one for each word to be joined
                none = pa.nulls(int((~here).sum()), pa.int64())
                columns = [
                    pa.array(np.concatenate([rows, row[~here] + done])), pa.array(np.concatenate([mix(rows.astype(np.uint64)).view(np.int64), word[~here]])),
                    *(pa.concat_arrays([pa.array(x), none]) for x in (n, *sums)), pa.concat_arrays([part.column(keep), pa.nulls(len(none), part.column(keep).type)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "word", "words", "total", "over", keep])
                done += walk.docs

    parts = docs.select(keep, "text").mapInArrow(run, f"row bigint, word bigint, words bigint, total bigint, over bigint, {keep} {kind}")
    parts = parts.join(ratios.select("word", "ratio"), "word", "left")
    total, over = F.coalesce("total", "ratio"), F.coalesce("over", F.greatest(F.lit(0), F.least(F.lit(most), F.col("ratio") - lowest)))
    found = parts.groupBy("row").agg(F.max(keep).alias(keep), F.max("words").alias("n"), F.sum(total).alias("total"), F.sum(over).alias("over"))
    mean = F.col("total") / UNIT / F.greatest("n", F.lit(1))
    return found.select(keep, mean.alias("mean"), (F.col("over") / UNIT / F.sqrt(F.col("n") + 1)).alias("clear"), F.log1p("n").alias("words"))


def _perhaps_marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be in ``marks``: a bitmap of ``2^FILTER_BITS`` bits (1 MiB, a fixed size) is
    broadcast, so most texts without a label need not be shuffled. The join that follows decides."""
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    word, bit = F.shiftright("_hash", 6), F.expr("shiftleft(1L, cast(_hash % 64 as int))")
    bitmap = marks.select(hash_.alias("_hash")).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    rows = docs.withColumn("_hash", hash_).withColumn("_word", word)
    rows = rows.join(F.broadcast(bitmap), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0)
    return rows.select(*docs.columns)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Labels are learned from rows whose fold (crc32 of the id, modulo 5) is not 0, from ``labels(doc_id, toxic)``; null
    labels teach nothing, and of several labels of one id the greatest counts. Null texts are empty; equal texts get
    equal scores. When the training rows lack one of the classes, every score is the share of toxic rows among them (0
    without any).
    """
    marks = labels.filter(F.col("toxic").isNotNull() & (fold(5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    texts = docs.select("doc_id", whole_text().alias("text"))
    kind = F.when(F.col("y") == 1, 1).otherwise(0) + F.when(fold(5) == 4, 2).otherwise(0)
    train = _perhaps_marked(texts.filter(fold(5) != 0), marks).join(marks, "doc_id").select("text", kind.cast("bigint").alias("kind"))
    train = cut_lineage(train, "training")
    found = cut_lineage(counts(train), "counts")
    first, last = ratio_model(found, False), ratio_model(found, True)
    weights = None
    if first is not None and last is not None:
        x = _with_features(train.filter("kind >= 2"), "kind", first)
        cells = x.groupBy(F.round(F.col("mean") * 50), F.round(F.col("clear") * 20), F.round(F.col("words") * 4))
        cells = cells.agg(*[F.avg(c).alias(c) for c in NAMES], F.sum(F.col("kind") - 2).alias("good"), F.count("kind").alias("n")).toPandas()
        if cells["good"].sum() > 0:
            weights = logistic(cells[list(NAMES)].to_numpy(), cells["good"].to_numpy(), cells["n"].to_numpy(dtype=float))
    if weights is None:
        scored = texts.select("doc_id", F.lit(float(train.agg(F.coalesce(F.avg(F.col("kind") % 2), F.lit(0.0))).first()[0])).alias("score"))
    else:
        line = sum((F.col(c) * float(w) for c, w in zip(NAMES, weights[:-1], strict=True)), F.lit(float(weights[-1])))
        scored = _with_features(texts, "doc_id", last).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
