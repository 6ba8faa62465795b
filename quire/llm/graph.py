"""Connected components over an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node that can be reached.

    Alternates large-star and small-star steps, each a partially aggregated minimum and a join that adaptive execution
    can split at a hub. Every round is written to the shared folder, so that a lost executor costs one round at most.
    No edges give no rows. Raises if the rounds don't suffice (they grow with the logarithm of the longest path).
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, "edges0")
    seen = _mark(now)
    for i in range(1, most_rounds + 1):
        if seen[0] == 0:
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), folder, f"edges{i}")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal marks mean that nothing moved."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
