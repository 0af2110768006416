"""Connected components of an edge table, by alternating star contractions (DataFrame functions only).

Each round ties every node to the least node it knows of, first among larger neighbours, then among smaller
ones; the number of rounds grows with the logarithm of the longest path.  Rounds are written to the shared
folder, so a lost executor costs no earlier round.  Groups are formed by aggregation and join, never by
collecting a node's neighbours, and AQE splits the join partitions of hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

ROUNDS = 64


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is the least node reachable.

    Nulls and loops are ignored; repeated and reversed edges do no harm.
    """
    current = scratch.materialize(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct(), "edges"
    )
    before = None
    for _ in range(ROUNDS):
        count, mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m") % (1 << 40))).collect()[0]
        if (count, mark) == before or not count:
            return current.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
                current.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
            )
        before = (count, mark)
        both = current.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            current.select(F.col("m").alias("u"), F.col("v").alias("w"))
        )
        least = both.groupBy("u").agg(F.min("w").alias("lw")).select("u", F.least("u", "lw").alias("least"))
        # Dealt anew before the join: a hub's rows can then be split, which they can't where the aggregate stands below the join.
        least = least.hint("rebalance")
        large = both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("least").alias("m"))
        large = large.filter("v != m").distinct()
        lower = large.groupBy("v").agg(F.min("m").alias("lm"))
        small = large.join(lower, "v")
        current = scratch.materialize(
            small.select("v", F.col("lm").alias("m"))
            .unionByName(small.filter("m != lm").select(F.col("m").alias("v"), F.col("lm").alias("m")))
            .distinct(),
            "edges",
        )
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
