"""Mixing sources to target weights by proportionate fair (Pfair) scheduling.

Documents of a source are cut into blocks of ``BLOCK_DOCS`` in the order of their ids. Block j (from 0) of a source with
weight w is released at slot floor(j / w) and due at slot ceil((j + 1) / w). In every slot the released block with the
earliest deadline goes next, so at any time a source is less than one block away from its weight times the slots.

Weights are whole numbers over ``PERIOD`` slots, so the schedule repeats: one period is worked out (its size depends on
the number of sources, not on the data) and gives block j of a source its slot by arithmetic. Target weights that the
data cannot follow to the end are handled in phases: when a source runs out, the others share its slots by their
weights, so every document has a place. Blocks are numbered by position within the source, found by ranges as in
``operators.sequencing``: no source is gathered in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import cut_lineage, query, table
from fleetlens.operators.sequencing import number_rows

BLOCK_DOCS = 16
PERIOD = 1024
#: Default target weights are the document counts to this power: large sources are toned down.
TEMPER = 0.5


def shares(weights: dict, period: int) -> dict:
    """Slots of each source in a period: largest remainders, at least one each; they add up to ``period``."""
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(slots, key=lambda s: (exact[s] - slots[s], str(s)), reverse=True)
    rest = period - sum(slots.values())
    while rest:
        for s in order if rest > 0 else sorted((s for s in slots if slots[s] > 1), key=lambda s: (exact[s] - slots[s], str(s))):
            slots[s] += 1 if rest > 0 else -1
            rest += -1 if rest > 0 else 1
            if not rest:
                break
    return slots


def period_slots(slots: dict, period: int) -> dict:
    """Earliest deadline first over one period: for each source the slots of its blocks, in order."""
    released: list = []
    later = [(0, -(-period // n), (str(s), s is None), s, 0) for s, n in slots.items()]
    heapq.heapify(later)
    out: dict = {s: [] for s in slots}
    for slot in range(period):
        while later and later[0][0] <= slot:
            release, due, key, s, j = heapq.heappop(later)
            heapq.heappush(released, (due, key, s, j, release))
        _, key, s, j, _ = heapq.heappop(released)
        out[s].append(slot)
        n = slots[s]
        if j + 1 < n:
            heapq.heappush(later, ((j + 1) * period // n, -(-(j + 2) * period // n), key, s, j + 1))
    return out


def phases(blocks: dict, weights: dict, period: int = PERIOD) -> list[tuple]:
    """The whole schedule as rows (source, first block, last block + 1, first slot, period length, slots of a period).

    A phase lasts until the first of its sources has run out; in its last period that source has no more blocks and its
    slots stay free.
    """
    rows, left, start, base = [], {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0
    while left:
        length = max(period, 1 << (2 * len(left) - 1).bit_length())
        slots = shares({s: weights[s] for s in left}, length)
        table_ = period_slots(slots, length)
        rounds = min(-(-left[s] // slots[s]) for s in left)
        for s in list(left):
            n = min(left[s], rounds * slots[s])
            rows.append((s, start[s], start[s] + n, base, length, table_[s]))
            start[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        base += rounds * length
    return rows


def mixed(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``source``, ``doc_id``, ``block``, ``slot``, ``release``, ``due`` for every different (source, doc_id).

    ``weights`` maps each source to a positive target weight; by default the number of documents to the power
    ``TEMPER``. Sources that it does not name get the least of its weights. A null source is a source of its own, and
    null ids come first. Rows with the same source and id share a place. Release and due are slots of the phase of the
    block, counted like ``slot`` from the start of the whole schedule.
    """
    ids = docs.select("source", "doc_id").distinct()
    numbered = number_rows(ids, "source", ["doc_id"])
    numbered = cut_lineage(numbered.select("source", "doc_id", F.floor((F.col("seq") - 1) / block_docs).alias("block")), "blocks")
    counts = {r["source"]: (r["blocks"], r["docs"]) for r in numbered.groupBy("source").agg((F.max("block") + 1).alias("blocks"), F.count("*").alias("docs")).collect()}
    if weights is None:
        weights = {s: docs_**TEMPER for s, (_, docs_) in counts.items()}
    weights = {s: weights.get(s, min(weights.values())) for s in counts}
    rows = phases({s: n for s, (n, _) in counts.items()}, weights)
    plan = docs.sparkSession.createDataFrame(rows, f"_source {docs.schema['source'].dataType.simpleString()}, first bigint, last bigint, base bigint, length bigint, slots array<bigint>")
    inside = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last"))
    at, n = F.col("block") - F.col("first"), F.size("slots")
    slot = F.col("base") + F.floor(at / n) * F.col("length") + F.element_at("slots", (at % n + 1).cast("int"))
    release = F.col("base") + F.floor(at * F.col("length") / n)
    due = F.col("base") + F.ceil((at + 1) * F.col("length") / n)
    # the plan has one row per source and phase
    return numbered.join(plan, inside).select("source", "doc_id", "block", slot.alias("slot"), release.alias("release"), due.alias("due"))


def in_mixing_order(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows and columns of ``docs``, partitioned and sorted by their slot: written to files in this order, the rows
    of the files follow the schedule."""
    place = mixed(docs, weights, block_docs).select(F.col("source").alias("_fl_source"), F.col("doc_id").alias("_fl_id"), F.col("slot").alias("_fl_slot"))
    rows = docs.join(place, F.col("source").eqNullSafe(F.col("_fl_source")) & F.col("doc_id").eqNullSafe(F.col("_fl_id")))
    rows = rows.repartitionByRange("_fl_slot", "_fl_id").sortWithinPartitions("_fl_slot", "_fl_id")
    return rows.select(*docs.columns)


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture of its source blocks."""
    return mixed(table(spark, sf_dir, "documents"))
