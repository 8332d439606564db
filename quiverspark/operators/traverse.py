"""Expansion over the adjacency, bounded by hops, and exact shortest paths.

Traversal advances one whole layer a step: the frontier is joined with the adjacency, what
was seen before is taken out by an anti-join, and the layer is written to the shared folder,
so that neither plans nor recovery grow with the number of hops.  The adjacency of a stored
graph is bucketed by node and is not shuffled again in any step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverspark.graph import Graph
from quiverspark.model import BOTH, EDGE, IN, NODE, OUT
from quiverspark.operators import filters, sketch
from quiverspark.operators.filters import ElementFilter, steps
from quiverspark.plans import planner
from quiverspark.plans.workspace import Seen, write_counted, write_table


def _ids(nodes: DataFrame) -> DataFrame:
    """Node ids of a set of elements, or of a frame that has ``id`` alone."""
    return nodes.where(F.col("kind") == NODE).select("id") if "kind" in nodes.columns else nodes.select("id")


def _require(graph: Graph, ids: DataFrame) -> None:
    missing = ids.join(graph.nodes.select("id"), "id", "left_anti").limit(1).collect()
    if missing:
        raise filters.NotFound("node", missing[0][0])


def expand(graph: Graph, seeds: DataFrame, direction: str = BOTH, label: str | None = None) -> DataFrame:
    """One hop from a set: neighbours and edges, seeds included where another seed reaches them."""
    ids = _ids(seeds)
    _require(graph, ids)
    met = steps(graph, direction, label).join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
    nodes = met.select(F.lit(NODE).cast("tinyint").alias("kind"), F.col("neighbor").alias("id"))
    return nodes.unionByName(met.select(F.lit(EDGE).cast("tinyint").alias("kind"), F.col("edge").alias("id"))).distinct()


def _layers(graph: Graph, seeds: DataFrame, hops: int, direction: str, label: str | None, edges: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """New nodes of each hop, and the edges met from each frontier; every node is expanded once.

    In both directions a neighbour of a layer lies in it, in the one before or in the next, so
    these two are all that new nodes are held against.
    """
    frontier = write_table(seeds.distinct(), "frontier")
    seen, nodes, met_edges = Seen(frontier, recent=direction == BOTH), [], []
    for _ in range(hops):
        met = steps(graph, direction, label).join(frontier.withColumnRenamed("id", "node"), "node", "left_semi")
        if edges:
            met = write_table(met.select("neighbor", "edge"), "met")
            met_edges.append(met.select("edge"))
        fresh, n = write_counted(met.select(F.col("neighbor").alias("id")).distinct().join(seen.frame, "id", "left_anti"), "frontier")
        if not n:
            break
        nodes.append(fresh)
        seen.add(fresh)
        frontier = fresh
    return nodes, met_edges


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for f in frames:
        out = out.unionByName(f)
    return out


def expand_hops(graph: Graph, seeds: DataFrame, hops: int, direction: str = BOTH, label: str | None = None) -> DataFrame:
    """Nodes and edges within ``hops``; seeds never, edges that lead back to them always."""
    ids = _ids(seeds)
    if hops > 0:
        _require(graph, ids)
    nodes, edges = _layers(graph, ids, hops, direction, label, edges=True)
    none = graph.spark.createDataFrame([], "id bigint")
    kept = _union(nodes, none).select(F.lit(NODE).cast("tinyint").alias("kind"), "id")
    met = _union(edges, none.withColumnRenamed("id", "edge")).distinct()
    return kept.unionByName(met.select(F.lit(EDGE).cast("tinyint").alias("kind"), F.col("edge").alias("id")))


def nodes_within_hops(graph: Graph, seeds: DataFrame, hops: int, direction: str = BOTH, label: str | None = None, include_seeds: bool = True, wanted: ElementFilter | None = None) -> DataFrame:
    """Nodes within ``hops``.  The filter is applied to what was reached, not to what is walked through."""
    ids = _ids(seeds)
    _require(graph, ids)
    nodes, _ = _layers(graph, ids, hops, direction, label, edges=False)
    reached = _union(nodes, graph.spark.createDataFrame([], "id bigint"))
    if include_seeds:
        reached = reached.unionByName(ids.distinct())
    if wanted is not None:
        reached = reached.join(graph.nodes.where(wanted.condition()).select("id"), "id", "left_semi")
    return reached.select(F.lit(NODE).cast("tinyint").alias("kind"), "id")


@dataclass(frozen=True)
class GraphRangeResult:
    hits: DataFrame
    candidate_nodes: int
    plan: planner.VectorPlan


def vector_search_graph_range(graph: Graph, query, seeds: DataFrame, k: int = 10, hops: int = 2, direction: str = BOTH, label: str | None = None, include_seeds: bool = True, wanted: ElementFilter | None = None) -> GraphRangeResult:
    """Vector search among the nodes around some seeds."""
    near, n = write_counted(nodes_within_hops(graph, seeds, hops, direction, label, include_seeds, wanted), "range")
    hits, plan = sketch.vector_search_within_adaptive(graph, query, near, k)
    return GraphRangeResult(hits, n, plan)


# --- shortest path -----------------------------------------------------------------------

FOUND, NOT_FOUND, LIMIT = "found", "not_found_within_hops", "expansion_limit"
ONE_SIDED, TWO_SIDED = "breadth_first", "bidirectional_breadth_first"


@dataclass(frozen=True)
class ShortestPath:
    """Nodes and edges of a path, or None, with the reason and what the search did."""

    nodes: list[int] | None
    edges: list[int] | None
    strategy: str
    termination: str
    visited: int
    start_expanded: int
    end_expanded: int
    examined: int

    @property
    def expanded(self) -> int:
        return self.start_expanded + self.end_expanded


class _Side:
    """One direction of the search: what it has reached, by depth, with parents."""

    def __init__(self, graph: Graph, root: int, direction: str, label: str | None):
        self.graph, self.direction = graph, direction
        self.walk, self.every = steps(graph, direction, label), graph.adjacency.where(filters.directions(direction))
        self.reached = self.frontier = write_table(graph.spark.createDataFrame([(root, 0, None, None)], "id bigint, depth int, parent bigint, edge bigint"), "side")
        self.layers, self.size, self.depth, self.expanded = [self.frontier], 1, 0, 0

    def work(self) -> int:
        """Expansions plus an upper bound of adjacency reads of the next layer, filters left out."""
        return self.size + self.every.join(self.frontier.select(F.col("id").alias("node")), "node", "left_semi").count()

    def advance(self, allowed: int) -> tuple[int, bool]:
        """Expand the layer in ascending node order, ``allowed`` nodes at most: edges examined, whether it was whole."""
        whole = self.size <= allowed
        ids = self.frontier.select("id") if whole else self.frontier.select("id").orderBy("id").limit(allowed)
        met = self.walk.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").select("node", "neighbor", "edge")
        met, examined = write_counted(met, "met")
        first = met.groupBy(F.col("neighbor").alias("id")).agg(F.min(F.struct("node", "edge")).alias("by"))
        fresh = first.join(self.reached.select("id"), "id", "left_anti").select("id", F.lit(self.depth + 1).alias("depth"), F.col("by.node").alias("parent"), F.col("by.edge").alias("edge"))
        fresh, size = write_counted(fresh, "side")
        self.expanded += self.size if whole else allowed
        self.reached = self.reached.unionByName(fresh)
        self.layers.append(fresh)
        self.frontier, self.size = fresh, size
        self.depth += whole
        return examined, whole

    def paths(self, ends: DataFrame, depth: int) -> DataFrame:
        """(id, nodes, edges) from the root to nodes of one depth, by following parents down the layers."""
        walk = ends.select("id", F.col("id").alias("at"), F.array("id").alias("nodes"), F.expr("cast(array() AS array<bigint>)").alias("edges"))
        for d in range(depth, 0, -1):
            step = self.layers[d].select(F.col("id").alias("at"), "parent", "edge")
            walk = walk.join(step, "at").select("id", F.col("parent").alias("at"), F.concat(F.array("parent"), "nodes").alias("nodes"), F.concat(F.array("edge"), "edges").alias("edges"))
        return walk.select("id", "nodes", "edges")


def shortest_path(graph: Graph, start: int, end: int, max_hops: int = 6, max_expansions: int = 100_000, direction: str = BOTH, label: str | None = None) -> ShortestPath:
    """An exact unweighted shortest path within bounds, the same one in every run.

    Among shortest paths that the two searches meet in, the one with the smallest node
    sequence, then edge sequence.  A search that its budget cut short says so and proves nothing.
    """
    filters.require_nodes(graph, [start, end])
    if start == end:
        return ShortestPath([start], [], ONE_SIDED, FOUND, 1, 0, 0, 0)
    if max_hops == 0:
        return ShortestPath(None, None, ONE_SIDED, NOT_FOUND, 1, 0, 0, 0)
    if max_hops == 1:
        return _one_hop_path(graph, start, end, max_expansions, direction, label)
    back = {OUT: IN, IN: OUT, BOTH: BOTH}[direction]
    ahead, behind = _Side(graph, start, direction, label), _Side(graph, end, back, label)
    best, examined = None, 0

    def result(nodes, edges, termination) -> ShortestPath:
        visited = ahead.reached.select("id").unionByName(behind.reached.select("id")).distinct().count()
        return ShortestPath(nodes, edges, TWO_SIDED, termination, visited, ahead.expanded, behind.expanded, examined)

    while True:
        stuck = ahead.depth + behind.depth >= max_hops or not ahead.size or not behind.size
        if best is not None and (ahead.depth + behind.depth >= best or stuck):
            return result(*_meeting(ahead, behind, best), FOUND)
        if stuck:
            return result(None, None, NOT_FOUND)
        left = max_expansions - ahead.expanded - behind.expanded
        fits = ahead.size <= left, behind.size <= left
        if fits[0] != fits[1]:
            side = ahead if fits[0] else behind
        else:
            side = ahead if (ahead.work(), ahead.size) <= (behind.work(), behind.size) else behind
        other = behind if side is ahead else ahead
        seen, whole = side.advance(left)
        examined += seen
        if not whole:
            return result(None, None, LIMIT)
        met = side.frontier.join(other.reached.select("id", F.col("depth").alias("far")), "id").agg(F.min(F.col("depth") + F.col("far"))).first()[0]
        if met is not None and met <= max_hops:
            best = met if best is None else min(best, met)


def _meeting(ahead: _Side, behind: _Side, length: int) -> tuple[list[int], list[int]]:
    """The smallest path of a length over all nodes in which the searches meet."""
    met = ahead.reached.select("id", "depth").join(behind.reached.select("id", F.col("depth").alias("far")), "id").where(F.col("depth") + F.col("far") == length)
    met = write_table(met, "meeting")
    best = None
    for (depth,) in met.select("depth").distinct().collect():
        here = met.where(F.col("depth") == depth)
        there = behind.paths(here, length - depth).select("id", F.reverse("nodes").alias("tail"), F.reverse("edges").alias("back"))
        both = ahead.paths(here, depth).join(there, "id").select(F.concat("nodes", F.slice("tail", 2, length)).alias("nodes"), F.concat("edges", "back").alias("edges"))
        row = both.orderBy("nodes", "edges").first()
        if best is None or (row["nodes"], row["edges"]) < best:
            best = row["nodes"], row["edges"]
    return best


def _one_hop_path(graph: Graph, start: int, end: int, max_expansions: int, direction: str, label: str | None) -> ShortestPath:
    if max_expansions == 0:
        return ShortestPath(None, None, ONE_SIDED, LIMIT, 1, 0, 0, 0)
    row = steps(graph, direction, label).where(F.col("node") == start).agg(
        F.count("*"), F.min(F.when(F.col("neighbor") == end, F.col("edge"))), F.count_distinct(F.when((F.col("neighbor") != start) & (F.col("neighbor") <= end), F.col("neighbor"))), F.count_distinct(F.when(F.col("neighbor") != start, F.col("neighbor")))
    ).first()
    examined, edge, up_to, all_of = row
    if edge is None:
        return ShortestPath(None, None, ONE_SIDED, NOT_FOUND, 1 + all_of, 1, 0, examined)
    return ShortestPath([start, end], [edge], ONE_SIDED, FOUND, 1 + up_to, 1, 0, examined)


def evidence_path(graph: Graph, start: int, end: int, **options) -> tuple[ShortestPath, DataFrame]:
    """A shortest path and its steps, hydrated: position, node, node label, edge, edge label, forward."""
    path = shortest_path(graph, start, end, **options)
    schema = "position int, id bigint, edge bigint"
    if path.nodes is None:
        rows = graph.spark.createDataFrame([], schema)
    else:
        rows = graph.spark.createDataFrame([(i, n, path.edges[i - 1] if i else None) for i, n in enumerate(path.nodes)], schema)
    nodes = graph.nodes.select("id", F.col("label").alias("node_label"), F.col("props").alias("node_props"))
    edges = graph.edges.select(F.col("id").alias("edge"), F.col("label").alias("edge_label"), "target")
    told = nodes.join(F.broadcast(rows), "id").join(F.broadcast(rows.select("edge").where("edge IS NOT NULL")).join(edges, "edge"), "edge", "left")
    return path, told.select("position", "id", "node_label", "node_props", "edge", "edge_label", (F.col("target") == F.col("id")).alias("forward")).orderBy("position")
