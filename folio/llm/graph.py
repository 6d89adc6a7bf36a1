"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.runtime import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) longs to (node, root), root being the smallest node reachable.

    Alternates two star rewrites. The first links every larger neighbour of a
    node to the smallest neighbour, the second every smaller one. A round ends in
    a written table, and only a count and a checksum reach the driver. Nodes
    without an edge don't occur in the result. No edges give an empty result.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen, k = scratch.save(now, "edges-0"), None, 0
    while True:
        # larger neighbours of u go to the smallest neighbour (u itself included)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # what remains at u, all smaller now, goes to the smallest of them
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        after = scratch.save(after, f"edges-{k}")
        row = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{k - 1}")
        now = after
        if tuple(row) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = tuple(row)
