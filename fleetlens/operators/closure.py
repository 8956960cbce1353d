"""Direct and transitive dependencies from an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage


def transitive_dependencies(edges: DataFrame) -> DataFrame:
    """(src, dst, depth, direct) with the least depth of every reachable pair.

    Semi-naive rounds: only pairs found in the last round are extended, pairs
    already known are dropped by an anti join, so cycles end. Every round is
    written to the shared folder, which cuts the lineage and survives lost
    executors; hot packages are split by the skew join of adaptive execution.
    """
    steps = cut_lineage(edges.select("src", "dst").distinct(), "edges")
    frontier = steps.withColumn("depth", F.lit(1).cast("bigint"))
    frontier = cut_lineage(frontier, "closure")
    rounds = [frontier]
    hop = steps.select(F.col("src").alias("_via"), F.col("dst").alias("_to"))
    depth = 1
    while True:
        depth += 1
        known = rounds[0]
        for r in rounds[1:]:
            known = known.unionByName(r)
        reached = (
            frontier.join(hop, F.col("dst") == F.col("_via"))
            .select("src", F.col("_to").alias("dst"))
            .distinct()
            .join(known.select("src", "dst"), ["src", "dst"], "left_anti")
            .withColumn("depth", F.lit(depth).cast("bigint"))
        )
        frontier = cut_lineage(reached, "closure")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.withColumn("direct", F.col("depth") == 1)
