"""Connected components by alternating large-star and small-star steps.

Public method: Kiveris et al., "Connected Components in MapReduce and Beyond"
(SoCC 2014).  Edges stay in the cluster; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Labels of all nodes with an edge to a smaller one.

    ``edges`` has two bigint columns ``u`` and ``v``; direction, repeats and
    self-loops don't matter, rows with a null are ignored.  Returns ``id`` and
    ``root``, the smallest id of the component, for every node but the roots
    themselves.  No edges give no rows.  A hub's rows are only ever aggregated
    by min() (combined before the shuffle) or joined (which AQE splits).  The
    rounds end when nothing moves; a round's tables go when the next is written.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges = materialise(edges, "edges")
    before = _state(edges)
    while before[0]:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = materialise(large, "large")
        # small star: the smaller neighbours of a node, and itself, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u > v")
            .distinct()
        )
        small = materialise(small, "small")
        discard(edges, large)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
