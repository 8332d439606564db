"""Connected components by alternating stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverspark.plans.workspace import drop_table, write_observed

MAX_ROUNDS = 100


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a working table, with a signature that tells whether a round changed them."""
    table, seen = write_observed(edges, "components", n=F.count(F.lit(1)), mark=F.bit_xor(F.xxhash64("u", "v")))
    return table, (seen["n"], seen["mark"] or 0)


def connected_components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component) for every node that an edge between two nodes touches; component is the smallest node id.

    Direction, repeats and self-edges do not matter.  Each round joins every node to its
    smallest neighbour and then every node to the smallest of those at or below it; the
    edge table never grows beyond the input's size plus one edge a node, and rounds are
    logarithmic in practice.  A hub's rows are pre-aggregated for the minimum and the join
    that follows can be split by adaptive execution.  Each round is written to the shared
    folder, so a lost executor costs one round.
    """
    a, b = F.col(source).cast("long"), F.col(target).cast("long")
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current, before = _written(pairs)
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following, after = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop_table(current)
        current = following
        if after == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError("components did not settle")
