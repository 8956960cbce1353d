"""Ordered work per key that does not depend on the size of a key.

A plain window over ``partitionBy(key)`` puts all rows of a key into one task,
and one repository may own a third of all pushes. Here the rows of a key are
cut into ranges first; a small summary per range links them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage

BUCKET_ROWS = 4096


def number_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``seq`` (1-based position within the key) and ``n`` (rows of the key).

    ``order`` has to be unique within a key. Rows are range partitioned by key
    and order, so the cut points follow the data and neither a hot key nor a
    hot day makes a large range. Positions inside (key, range) are then shifted
    by the rows of earlier ranges: a running sum over one row per key and range.
    The ranges are written out first, because cut points are sampled and have
    to be the same for both uses.
    """
    ranged = df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    rows = cut_lineage(ranged, "ranges")
    local = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    sizes = rows.groupBy(key, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(key).alias("_key"),
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(key)).alias("n"),
    )
    return (
        local.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
        .withColumn("seq", (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .drop("_range", "_rank", "_key", "_r", "_offset")
    )


def trailing_frame(numbered: DataFrame, key: str, rows: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over the current and the ``rows - 1`` preceding rows of each key.

    Works on numbered rows: a window per block of ``BUCKET_ROWS`` consecutive
    rows, where the last ``rows - 1`` rows of a block are also sent to the next
    block, so every frame is complete and no block grows with its key.
    """
    block = F.floor((F.col("seq") - 1) / BUCKET_ROWS)
    tail = F.pmod(F.col("seq") - 1, F.lit(BUCKET_ROWS)) >= BUCKET_ROWS - (rows - 1)
    blocks = F.when(tail & (F.col("seq") < F.col("n")), F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("_block", F.explode(blocks))
    frame = Window.partitionBy(key, "_block").orderBy("seq").rowsBetween(-(rows - 1), 0)
    out = spread.select("*", *[agg.over(frame).alias(name) for name, agg in aggregates.items()])
    return out.filter(block == F.col("_block")).drop("_block")


def newest_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The ``n`` newest rows per key. Spark keeps at most ``n`` rows of a key per
    task before it shuffles (WindowGroupLimit), so a hot key stays small. For
    that it sorts what a task reads; rows are dealt first, by all columns, so
    that this is not the whole of a file that cannot be split."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.repartition(*df.columns).withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
