"""Connected components of a table of links by contraction, in rounds that each write a restart point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import cut_lineage


def spread_join(rows: DataFrame, key: str, other: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``rows.join(other, key)`` for a key that may hold any share of ``rows``; ``other`` has one row a key.

    ``by`` deals the rows of a key to salts, as many as there are shuffle partitions. The different (key, salt) of
    ``rows`` are joined first, then the rows by both.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_fl_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    found = salted.groupBy(key, "_fl_salt").agg(F.lit(1).alias("_fl_one")).drop("_fl_one").join(other, key)
    return salted.join(found, [key, "_fl_salt"], how).drop("_fl_salt")


def follow(rows: DataFrame, column: str, up: DataFrame, by: Column) -> DataFrame:
    """``rows`` with ``column`` replaced by the ``parent`` that ``up(node, parent)`` has for it, if any."""
    known = up.select(F.col("node").alias(column), F.col("parent").alias("_fl_up"))
    return spread_join(rows, column, known, by, "left").withColumn(column, F.coalesce("_fl_up", column)).drop("_fl_up")


def _edges(links: DataFrame) -> DataFrame:
    return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (one node of its component, the same for all) for every node of ``links(a, b)``.

    In a round every node moves to the least of its neighbours and itself; links between nodes that moved to the same
    one vanish, the others are replaced by the links between the new places, each kept once. So a star is one node after
    two rounds, whatever its size. In every third round "least" goes by a hash, which shrinks any graph by a constant
    factor, long chains too. The moves are followed back at the end. No node's links are gathered, and joins deal the
    rows of one node to many tasks.
    """
    edges, moves = cut_lineage(_edges(links), f"{label}-links"), []
    while not edges.isEmpty():
        turn = len(moves)
        rank = (lambda c: F.struct(F.lit(0).alias("h"), c.alias("x"))) if turn % 3 < 2 else (lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("x")))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = both.groupBy("node").agg(F.min(rank(F.col("to"))).alias("to")).select("node", F.least(rank(F.col("node")), F.col("to"))["x"].alias("parent"))
        up = cut_lineage(up, f"{label}-moves")
        moves.append(up)
        moved = follow(follow(edges, "a", up, F.col("b")), "b", up, F.col("a"))
        edges = cut_lineage(_edges(moved), f"{label}-links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop()
    while moves:
        roots = cut_lineage(follow(moves.pop(), "parent", roots, F.col("node")), f"{label}-roots")
    return roots.select("node", F.col("parent").alias("root"))
