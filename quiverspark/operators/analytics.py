"""Whole-graph analytics: distances, components and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverspark.graph import Graph
from quiverspark.operators import filters
from quiverspark.operators.components import connected_components
from quiverspark.plans.workspace import Seen, drop_table, partitions_for, write_bucketed, write_counted, write_observed, write_table

UNREACHABLE = (1 << 63) - 1
DAMPING, ITERATIONS = 0.85, 10
#: Links a bucket: so many are sorted in memory.
ROWS_A_BUCKET = 1 << 19


def bfs(graph: Graph, source: int, max_depth: int | None = None) -> DataFrame:
    """(node, distance) along outgoing edges; null where the source does not reach."""
    filters.require_nodes(graph, [source])
    out = filters.steps(graph, "out").select("node", "neighbor")
    frontier = write_table(graph.spark.createDataFrame([(source, 0)], "node bigint, distance bigint"), "layer")
    seen, depth = Seen(frontier), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = out.join(frontier.select("node"), "node", "left_semi").select(F.col("neighbor").alias("node")).distinct().join(seen.frame.select("node"), "node", "left_anti")
        frontier, n = write_counted(fresh.withColumn("distance", F.lit(depth).cast("bigint")), "layer")
        if not n:
            break
        seen.add(frontier)
    return graph.nodes.select(F.col("id").alias("node")).join(seen.frame, "node", "left")


def wcc(graph: Graph) -> DataFrame:
    """(node, component): the smallest node id of each weakly connected component."""
    touched = connected_components(graph.ends)
    return graph.nodes.select(F.col("id").alias("node")).join(touched, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def pagerank(graph: Graph, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(node, rank) after a fixed number of rounds; dangling mass is spread evenly, parallel edges count each.

    Shares go along edges that were counted once per (source, target) and are stored bucketed
    by source, so a round shuffles the ranks and the partial sums by target, not the edges.
    """
    nodes = graph.nodes.select(F.col("id").alias("node"))
    n = graph.node_count
    if n == 0:
        return graph.spark.createDataFrame([], "node bigint, rank double")
    buckets = max(partitions_for(graph.ends), -(-graph.edge_count // ROWS_A_BUCKET))
    ends = graph.ends.repartition(buckets, "source")  # the one time that edges move: what follows is counted where they lie
    pairs = ends.groupBy("source", "target").agg(F.count("*").alias("w"))
    out = graph.ends.groupBy("source").agg(F.count("*").alias("out"))
    shares = pairs.join(ends.groupBy("source").agg(F.count("*").alias("out")), "source").select("source", "target", (F.col("w") / F.col("out")).alias("share"))
    links, table = write_bucketed(shares, "links", "source", buckets, dealt=True)
    lost = F.sum(F.when(F.col("dangling"), F.col("rank")))  # taken while a round's ranks are written
    first = nodes.join(out.withColumnRenamed("source", "node"), "node", "left").select("node", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank"))
    ranks, seen = write_observed(first, "ranks", lost=lost)
    for _ in range(iterations):
        base = (1 - damping) / n + damping * (seen["lost"] or 0.0) / n
        sums = links.join(ranks.select(F.col("node").alias("source"), "rank"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        fresh = ranks.select("node", "dangling").join(sums, "node", "left").select("node", "dangling", (F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        fresh, seen = write_observed(fresh, "ranks", lost=lost)
        drop_table(ranks)
        ranks = fresh
    drop_table(links)
    graph.spark.sql(f"DROP TABLE {table}")
    return ranks.select("node", "rank")


def with_sentinel(distances: DataFrame) -> DataFrame:
    """Distances as reference files have them: the largest long for what is out of reach."""
    return distances.select("node", F.coalesce("distance", F.lit(UNREACHABLE)).alias("distance"))


def mismatches(found: DataFrame, truth: DataFrame, column: str, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """Nodes whose value is missing, or beyond both tolerances."""
    both = truth.select("node", F.col(column).alias("wanted")).join(found.select("node", F.col(column).alias("got")), "node", "full")
    off = F.abs(F.col("wanted") - F.col("got"))
    return both.where(F.col("wanted").isNull() | F.col("got").isNull() | ((off > absolute) & (off > relative * F.abs(F.col("wanted")))))
