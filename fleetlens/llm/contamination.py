"""Benchmark items inside documents: containment search by size-partitioned MinHash, then exact verification.

Items and documents are sets of five-word shingles (lower case; words are runs of letters and digits). Items are
partitioned by size: in the partition of sizes 2^i to 2^(i+1) an item is represented by its ``k`` shingles of least hash
(a bottom-k MinHash sample of the item), or by all of them if it has no more. A document that holds a share of at least
``threshold`` of an item holds about that share of the sample, however long the document is: it becomes a candidate when
it holds ``need`` of them, where ``need`` is the largest number that such a document misses with a probability below
1e-9. Pairs whose document is too small to hold that share are left out by size. Candidates are verified by the exact
share of the item's shingles in the document.

All steps are DataFrame expressions. The side of the samples is broadcast by Spark when its measured size allows it, and
shuffled otherwise.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import query, table, whole_text

SHINGLE = 5
THRESHOLD = 0.8
SAMPLE = 24
MISS = 1e-9
GAP = r"[^\p{L}\p{N}]+"


def word_list(text: str) -> Column:
    return F.array_remove(F.split(F.lower(whole_text(text)), GAP), "")


def shingle_set(words: str) -> Column:
    """Hashes of the different shingles; empty for fewer than five words."""
    count = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, j + 1, count) for j in range(SHINGLE)])
    return F.array_distinct(F.transform(shifted, lambda z: F.xxhash64(z)))


def needed(size: int, threshold: float) -> int:
    """The hits asked of a sample of ``size`` shingles: a document at the threshold has fewer with less than MISS."""
    chance, hits = 0.0, 0
    while hits < size:
        chance += comb(size, hits) * threshold**hits * (1 - threshold) ** (size - hits)
        if chance > MISS:
            break
        hits += 1
    return max(1, hits)


def with_shingles(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``shingles`` and drops the words."""
    return rows.withColumn("_fl_words", word_list(text)).withColumn("shingles", shingle_set("_fl_words")).drop("_fl_words")


def item_samples(items: DataFrame, threshold: float) -> DataFrame:
    """``item``, ``need``, ``h``: one row per sampled shingle."""
    size = F.size("shingles")
    part = F.floor(F.log2(size)).cast("int")  # the partition by size
    sample = F.when(F.pow(F.lit(2.0), F.col("part") + 1) <= SAMPLE, size).otherwise(F.least(size, F.lit(SAMPLE)))
    whole = F.ceil(size * threshold - 1e-9)
    need = F.when(sample == size, whole).otherwise(F.lit(needed(SAMPLE, threshold)))
    rows = items.withColumn("part", part).select("item", need.alias("need"), F.slice(F.array_sort("shingles"), 1, sample).alias("s"))
    return rows.select("item", "need", F.explode("s").alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``text_hash``, ``item_id``, ``matched``, ``item_shingles``, ``containment`` of every document that
    holds at least ``threshold`` of the shingles of an item.

    ``docs(doc_id, text)`` and ``items(item_id, text)``; other columns are ignored. Null texts are empty. Items with
    fewer than five words have no shingle and match nothing. Rows that are repeated whole give one row; ids that occur
    with several texts are told apart by ``text_hash``, and null ids are kept.
    """
    keyed = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), "text")
    wanted = with_shingles(items.select("item_id", "text").distinct(), "text").filter(F.size("shingles") > 0)
    wanted = wanted.select("item_id", F.xxhash64("item_id", "text").alias("item"), "shingles")
    # explode_outer, as Spark would put a filter on the number of shingles below the expressions that make them
    known = with_shingles(keyed, "text").select("doc_id", "text_hash", F.explode_outer("shingles").alias("h"))
    hits = known.join(item_samples(wanted, threshold), "h")
    candidates = hits.groupBy("doc_id", "text_hash", "item").agg(F.count_distinct("h").alias("hits"), F.first("need").alias("need"))
    candidates = candidates.filter("hits >= need").select(F.col("doc_id").alias("_fl_id"), F.col("text_hash").alias("_fl_hash"), "item")
    same = F.col("doc_id").eqNullSafe(F.col("_fl_id")) & (F.col("text_hash") == F.col("_fl_hash"))
    found = with_shingles(keyed.join(candidates, same).select("doc_id", "text_hash", "item", "text"), "text").withColumnRenamed("shingles", "own")
    found = found.join(wanted, "item").withColumn("matched", F.size(F.array_intersect("shingles", "own")).cast("bigint"))
    share = F.col("matched") / F.col("item_shingles")
    found = found.select("doc_id", "text_hash", "item_id", "matched", F.size("shingles").cast("bigint").alias("item_shingles"))
    return found.withColumn("containment", share).filter(F.col("containment") >= threshold).distinct()


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all columns."""
    bad = contained_items(docs, items, threshold).select(F.col("doc_id").alias("_fl_id"), F.col("text_hash").alias("_fl_hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_fl_id")) & (F.xxhash64(whole_text()) == F.col("_fl_hash")), "left_anti")


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _shingle_sql(id: str, source: str) -> str:
    following = ", ".join(f"lead(word, {j}) OVER w AS w{j}" for j in range(1, SHINGLE))
    joined = " || ' ' || ".join(["word", *(f"w{j}" for j in range(1, SHINGLE))])
    return f"""SELECT DISTINCT {id}, {joined} AS s FROM (SELECT {id}, word, {following} FROM
        (SELECT {id}, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT {id}, {_WORDS} AS w FROM {source}))
        WINDOW w AS (PARTITION BY {id} ORDER BY pos)) WHERE w{SHINGLE - 1} IS NOT NULL"""


@query(
    "op5_decontamination",
    f"""WITH ds AS ({_shingle_sql("doc_id", "documents")}), si AS ({_shingle_sql("item_id", "benchmark")}),
    n AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id)
    SELECT doc_id, item_id, matched, item_shingles, matched / item_shingles AS containment FROM
    (SELECT doc_id, item_id, count(*) AS matched FROM ds JOIN si USING (s) GROUP BY ALL) JOIN n USING (item_id)
    WHERE matched / item_shingles >= {THRESHOLD}""",
)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
