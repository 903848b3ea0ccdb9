"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (large: the greater ones; small: the smaller ones and itself) to its least neighbour."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    edges: columns u and v of one orderable type; loops and repeats are dropped. Each round is written to the shared folder, so lineage doesn't
    grow. Rounds end when the edges no longer change, after a number that grows as the logarithm of the size.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    shape = None
    for _ in range(most_rounds):
        now = materialize(_star(_star(now, True).distinct(), False).where("u <> v").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen.n, seen.x) == shape:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        shape = (seen.n, seen.x)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
