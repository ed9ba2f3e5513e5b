"""Transitive closure of an edge table, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.shared import cut


def reachable(start: DataFrame, edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, root, node, depth): every node reached from each root over ``edges`` (keys, src, dst), the root itself at depth 0.

    ``start`` is (keys, root). Cycles end: a node counts once, at its least
    depth. Each level is a join of what was new with the edges and an anti-join
    with what is known, written before the next one, so lineage stays short and
    a lost executor costs a level at most.
    """
    keys = list(keys)
    known = cut(start.select(*keys, "root").distinct().withColumn("node", F.col("root")).withColumn("depth", F.lit(0)), "reach")
    fresh, depth = known, 0
    while True:
        depth += 1
        step = fresh.withColumnRenamed("node", "src").join(edges, [*keys, "src"]).select(*keys, "root", F.col("dst").alias("node")).distinct()
        fresh = cut(step.join(known.select(*keys, "root", "node"), [*keys, "root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh), "reach") if depth % 8 == 0 else known.unionByName(fresh)
