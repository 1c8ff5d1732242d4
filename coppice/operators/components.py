"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.sources.stored import drop, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that it reaches.

    Each round is a table of its own, which ends its lineage; the one before it is deleted. The number
    of rounds grows with the logarithm of the number of nodes. Loops and repeated edges are
    allowed; edges with a null end are left out. The last table stays, as the result reads it.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL")
    e, before = written(e.distinct(), "components"), None
    while True:
        # large star: of each node, the larger neighbours go to its smallest neighbour
        both = e.select("u", "v").unionByName(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(e.where("u = v")).distinct()
        # small star: of each node, its smaller neighbours and itself go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, written(small, "components")
        drop(old)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
