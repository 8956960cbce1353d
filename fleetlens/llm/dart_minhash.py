"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the multiset of its five-word shingles (lower case; words are runs of letters and digits). Every shingle
owns a half plane of weight and rank, cut into unit regions; a hash of (shingle, region) throws a Poisson(1) number of
darts into each region, the same darts for every document. A document sees the darts below its shingle weights. Each
dart belongs to one of ``k`` coordinates; the earliest rank of a coordinate is its signature value, so two documents
agree on a coordinate with the probability of their weighted Jaccard similarity. Ranks are visited only as far as about
``k (ln k + 4)`` darts reach; a document with an empty coordinate goes twice as far.

Bands of the signature are joined into groups of candidates. Within groups, texts are linked by the exact weighted
Jaccard similarity of their shingles, and linked texts form classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import GOLD, cut_lineage, digest, hash_spans, likely_in, lower_bytes, map_batches, mix, query, shingle_hashes, slices, table, word_spans, whole_text
from fleetlens.llm.components import components, follow, spread_join

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 6
#: Shingles in a block of a large group, and in a chunk of small groups that are compared at once.
BLOCK, CHUNK = 400_000, 400_000
#: Bytes of text looked at at once, and darts thrown at once: both bound the memory of a task. A single text may need more.
SLICE, DARTS = 1 << 20, 1 << 19
#: Texts in a block of a large group, and rows of a square of its texts that are counted at once.
TEXTS, TILE = 2000, 256
#: A shingle of more rows than this is counted in a square of its group instead of as pairs.
WIDE = 48

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    low, at = lower_bytes(raw, offsets)
    starts, ends, rows = word_spans(low, at)
    return shingle_hashes(hash_spans(low, starts, ends), rows, size)


def occurrences(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted within rows, and for each how many equal ones stand before it in the row."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    values = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return values, np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))


def _throw(keys: np.ndarray, rows: np.ndarray, cells: np.ndarray, k: int, out: np.ndarray) -> None:
    """Throw the darts of ranks 0 to ``cells`` of each key and keep the earliest of each row and coordinate."""
    reach = np.repeat(keys, cells)
    begin = np.cumsum(cells) - cells
    rank = np.arange(len(reach)) - np.repeat(begin, cells)
    region = mix(reach + rank.astype(np.uint64) * GOLD)
    thrown = np.searchsorted(_POISSON, (region >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
    begin = np.cumsum(thrown) - thrown
    nth = np.arange(int(thrown.sum())) - np.repeat(begin, thrown)
    dart = mix(np.repeat(region, thrown) ^ ((nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
    coordinate = ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
    # rank: whole cells and 24 bits within the cell; then 28 bits that name the dart
    when = (np.repeat(rank, thrown).astype(np.uint64) << np.uint64(24)) | (dart >> np.uint64(40))
    value = (when << np.uint64(28)) | (mix(dart) >> np.uint64(36))
    cell = np.repeat(np.repeat(rows, cells), thrown) * k + coordinate.astype(np.int64)
    np.minimum.at(out.reshape(-1), cell, value)


def signatures(values: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """A ``rows x k`` signature of the weighted shingle sets; rows without shingles have the largest value everywhere."""
    values, seen = occurrences(values, offsets)
    keys = mix(values + (seen.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    size = np.diff(offsets)
    empty = np.iinfo(np.uint64).max
    out = np.full((len(size), k), empty, dtype=np.uint64)
    reach = np.ceil(k * (math.log(k) + 4) / np.maximum(size, 1)).astype(np.int64)
    todo = np.flatnonzero(size > 0)
    while len(todo):
        for part in np.array_split(todo, max(1, int((size[todo] * reach[todo]).sum() // DARTS))):
            if len(part):
                items = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in part])
                rows = np.repeat(part, size[part])
                _throw(keys[items], rows, np.repeat(reach[part], size[part]), k, out)
        todo = todo[(out[todo] == empty).any(axis=1)]
        reach[todo] *= 2
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    total = np.zeros((len(sig), bands), dtype=np.uint64)
    for j in range(rows):
        total = mix(total * np.uint64(31) + parts[:, :, j])
    return (total + np.arange(bands, dtype=np.uint64) * GOLD).view(np.int64)


def band_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each different text: ``digest``, its number of shingles ``n``, a 128-bit hash of their multiset
    (``bag_a``, ``bag_b``), and its band keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, bags = [], [], []
        for _, raw, offsets in slices(batch, "text", SLICE):
            values, at = shingles(raw, offsets)
            sizes.append(np.diff(at))
            sums = [np.append(np.uint64(0), np.cumsum(mix(values + salt), dtype=np.uint64)) for salt in (GOLD, np.uint64(0xD6E8FEB86659FD93))]
            bags.append(np.stack([x[at[1:]] - x[at[:-1]] for x in sums]).view(np.int64))
            keys.append(band_keys(signatures(values, at, BANDS * ROWS)))
        keys, sizes, bags = np.concatenate(keys), np.concatenate(sizes), np.concatenate(bags, axis=1)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(sizes, pa.int64()), *(pa.array(x) for x in bags), flat], ["digest", "n", "bag_a", "bag_b", "bands"])

    rows = map_batches(docs.select(digest(text).alias("digest"), whole_text(text).alias("text")), work, "digest binary, n bigint, bag_a bigint, bag_b bigint, bands array<bigint>")
    return rows.dropDuplicates(["digest"])


def _keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (shingle, occurrence): equal keys of two rows count the weight their shingles share."""
    values, at = shingles(raw, offsets)
    values, seen = occurrences(values, at)
    return mix(values + (seen.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)), at


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each ``a`` and ``b``; every label is the least row of its tree, before and after."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def links(keys: np.ndarray, offsets: np.ndarray, group: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked to a row before them: ``(row, first)``, a spanning forest of the pairs of one group with an exact
    weighted Jaccard similarity of at least ``threshold``. ``group`` is sorted."""
    m, size = len(offsets) - 1, np.diff(offsets)
    rows = np.repeat(np.arange(m), size)
    start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [m]])
    own = mix(keys + mix(np.repeat(start[:-1], np.diff(start))[rows].astype(np.uint64) * GOLD))
    order = np.argsort(own, kind="stable")
    own, rows = own[order], rows[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    count = np.diff(np.append(first, len(own)))
    wide = count > WIDE
    shared: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for d in np.unique(count[(count > 1) & ~wide]):  # keys of few rows: their pairs, counted
        table_ = rows[first[count == d][:, None] + np.arange(d)]
        a, b = np.triu_indices(int(d), 1)
        shared.append(np.unique(table_[:, a].reshape(-1) * m + table_[:, b].reshape(-1), return_counts=True))
    pair, back = np.unique(np.concatenate([x for x, _ in shared]), return_inverse=True)
    common = np.bincount(back, weights=np.concatenate([n for _, n in shared]), minlength=len(pair)).astype(np.int32)
    del shared, back
    a, b, label = pair // max(m, 1), pair % max(m, 1), np.arange(m)
    of_wide = np.searchsorted(start, rows[first[wide]], side="right") - 1
    tiled = np.zeros(len(start), dtype=bool)
    tiled[of_wide] = True
    alone = ~tiled[np.searchsorted(start, a, side="right") - 1]

    def close(a, b, common):
        return common >= threshold * (size[a] + size[b] - common) - 1e-9

    near = alone & close(a, b, common)
    _unite(label, a[near], b[near])
    for g in np.unique(of_wide):  # keys of many rows: the square of their group, a tile of rows at a time
        lo, hi = start[g], start[g + 1]
        members = [rows[f : f + d] for f, d in zip(first[wide][of_wide == g], count[wide][of_wide == g], strict=True)]
        for t in range(lo, hi, TILE):
            square = np.zeros((min(TILE, hi - t), hi - lo), dtype=np.int32)
            for at in members:
                i, j = np.searchsorted(at, (t, t + TILE))
                square[np.ix_(at[i:j] - t, at[i:] - lo)] += 1
            i, j = np.searchsorted(a, (t, min(t + TILE, hi)))
            square[a[i:j] - t, b[i:j] - lo] += common[i:j]
            x, y = np.nonzero(square)
            n, x, y = square[x, y], x + t, y + lo
            near = (y > x) & close(x, y, n)
            _unite(label, x[near], y[near])
    child = np.flatnonzero(label != np.arange(m))
    return child, label[child]


def _links_of_groups(threshold: float):
    """Over rows sorted by group: exact links, a chunk of whole groups at a time."""

    def run(batches):
        keys: list[np.ndarray] = []
        group: list[tuple] = []
        name: list[bytes] = []

        def flush(n: int):
            ids = np.unique([hash(g) for g in group[:n]], return_inverse=True)[1] if n else np.empty(0, np.int64)
            change = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])]) if n else ids
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys[:n]])]).astype(np.int64)
            a, b = links(np.concatenate(keys[:n]), at, change, threshold)
            out = pa.RecordBatch.from_arrays([pa.array([name[i] for i in x], pa.binary()) for x in (a, b)], ["a", "b"])
            del keys[:n], group[:n], name[:n]
            return out

        for batch in batches:
            for part, raw, offsets in slices(batch, "text", SLICE):
                found, at = _keys(raw, offsets)
                keys += np.split(found, at[1:-1])
                group += list(zip(*(part.column(c).to_pylist() for c in ("root", "low", "high")), strict=True))
                name += part.column("digest").to_pylist()
                n = len(group) - 1
                while n and group[n - 1] == group[-1]:
                    n -= 1
                if n and sum(len(k) for k in keys[:n]) > CHUNK:
                    yield flush(n)
        if group:
            yield flush(len(group))

    return run


def near_classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``digest``, ``root`` for every different text: texts with the same root are linked by pairs of at least
    ``threshold``, directly or through others.

    Equal texts are one text, and texts of the same shingles are linked to one of them, which stands for all. Texts that
    share a band bucket, directly or through others, form a group; every candidate pair lies in one group. A group is
    dealt into blocks of about ``BLOCK`` shingles or ``TEXTS`` texts, each pair of blocks is one unit of
    work that compares its texts exactly, and only a spanning forest of the links leaves it, never the pairs. Null and
    empty texts, and texts without a word, have no shingles and stay alone with their equal texts.
    """
    base = cut_lineage(band_table(docs, text), "bands")
    bags = base.filter("n > 0").groupBy("bag_a", "bag_b").agg(F.min("digest").alias("lead"), F.count("*").alias("texts"))
    bags = cut_lineage(bags.filter("texts > 1").drop("texts"), "bags")
    same = base.filter("n > 0").select("digest", "bag_a", "bag_b").join(bags, ["bag_a", "bag_b"]).filter("digest != lead").select(F.col("digest").alias("a"), F.col("lead").alias("b"))
    same = cut_lineage(same, "same")
    leads = base.filter("n > 0").join(same.select(F.col("a").alias("digest")), "digest", "left_anti")
    buckets = leads.select("digest", F.explode("bands").alias("band"))
    heads = buckets.groupBy("band").agg(F.min("digest").alias("head"), F.max("digest").alias("last")).filter("head < last").select("band", "head")
    # a text is tied to the least head of its buckets, and their other heads to that one
    tied = buckets.join(heads, "band").groupBy("digest").agg(F.min("head").alias("root"), F.collect_set("head").alias("heads"))
    tied = cut_lineage(tied, "tied")
    links = tied.select(F.col("root").alias("a"), F.explode("heads").alias("b")).filter("a != b").distinct()
    up = components(links, "groups").withColumnRenamed("root", "parent")
    groups = follow(tied.select("digest", "root"), "root", up, F.col("digest")).join(base.select("digest", "n"), "digest")
    groups = cut_lineage(groups, "groups")
    blocks = groups.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / TEXTS)).cast("int").alias("blocks"))
    dealt = spread_join(groups, "root", blocks, F.col("digest")).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = dealt.select("digest", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("digest", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    texts = docs.select(digest(text).alias("digest"), whole_text(text).alias("text"))
    texts = likely_in(texts, groups, "digest").dropDuplicates(["digest"])  # the join below drops the others
    units = texts.join(dealt, "digest").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "digest")
    found = cut_lineage(units.mapInArrow(_links_of_groups(threshold), "a binary, b binary"), "links")
    up = components(found).withColumnRenamed("root", "parent")
    leads = base.select("digest").join(same.withColumnRenamed("a", "digest").withColumnRenamed("b", "root"), "digest", "left")
    return follow(leads.withColumn("root", F.coalesce("root", "digest")), "root", up, F.col("digest"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its id, ``class_id`` (least id of its class) and ``kept``.

    ``kept`` holds for the rows with the least (id, digest) of their class; a row that occurs several times is kept as
    often, and ``one_per_class`` keeps one. Ids may be null (they count as the least) or repeated.
    """
    rows = cut_lineage(docs.select(F.col(id).alias("doc_id"), digest(text).alias("digest")), "ids")
    classed = cut_lineage(spread_join(rows, "digest", near_classes(docs, text, threshold), F.col("doc_id")), "classes")
    first = classed.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.min("doc_id").alias("class_id"))
    return spread_join(classed, "root", first, F.col("doc_id")).select("doc_id", "class_id", F.struct("doc_id", "digest").eqNullSafe(F.col("first")).alias("kept"), "digest")


def one_per_class(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates: one row of each class, with all columns."""
    keep = near_duplicates(docs, id, text, threshold).filter("kept").select(F.col("doc_id").alias("_fl_id"), F.col("digest").alias("_fl_digest")).distinct()
    rows = docs.withColumn("_fl_key", digest(text))
    kept = rows.join(keep, F.col(id).eqNullSafe(F.col("_fl_id")) & (F.col("_fl_key") == F.col("_fl_digest")), "left_semi")
    return kept.dropDuplicates([id, "_fl_key"]).drop("_fl_key")


@query("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates (five-word shingles, similarity 0.8)."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
