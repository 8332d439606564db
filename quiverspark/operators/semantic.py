"""Best-first semantic expansion.

A score may rise along a path, so the result depends on the order in which states are taken
and no layer-wise relaxation gives it.  Spark scores the neighbourhood of the seeds (elements
and degrees of what lies within ``max_hops``) and counts its steps.  Up to ``gathered_edges``
one exact heap runs over them in a task of its own.  Beyond it the same heap runs on the
driver, and the steps of nodes are fetched from the written table, sorted by node, for the
best of the heap at a time: ``max_expansions`` bounds the nodes whose steps are ever held.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverspark.graph import Graph
from quiverspark.model import BOTH, EDGE, NODE, NODES, InvalidArgument
from quiverspark.operators import filters, sketch, traverse, vectors
from quiverspark.operators.filters import steps
from quiverspark.plans.workspace import partitions_for, write_counted, write_table


@dataclass(frozen=True)
class SemanticPathOptions:
    seed_count: int = 32
    limit: int = 20
    max_hops: int = 2
    max_expansions: int = 10_000
    direction: str = BOTH
    seed_label: str | None = None
    edge_label: str | None = None
    node_weight: float = 0.6
    edge_weight: float = 0.4
    path_decay: float = 0.55
    hop_penalty: float = 0.92
    degree_penalty: float = 0.04
    include_seeds: bool = False
    gathered_edges: int = 5_000_000  # steps that one task may hold; beyond, they are fetched as they are needed

    def check(self) -> None:
        if self.seed_count == 0:
            raise InvalidArgument("semantic paths need seeds")
        numbers = (self.node_weight, self.edge_weight, self.path_decay, self.hop_penalty, self.degree_penalty)
        if not all(math.isfinite(x) for x in numbers):
            raise InvalidArgument("semantic path options must be finite")
        if min(self.node_weight, self.edge_weight) < 0 or self.node_weight + self.edge_weight <= np.finfo(np.float32).eps:
            raise InvalidArgument("node and edge weights must not be negative, nor both zero")
        if not 0 <= self.path_decay <= 1 or not 0 <= self.hop_penalty <= 1 or self.degree_penalty < 0:
            raise InvalidArgument("decay and hop penalty lie between zero and one, the degree penalty not below zero")


PATH_DDL = "seed bigint, node bigint, score double, seed_score double, path array<bigint>"


FETCHED_AT_ONCE = 500


class Fetched:
    """Steps by node, read from a written table for several nodes at once."""

    def __init__(self, moves: DataFrame):
        self.moves, self.held = moves, {}

    def wanted(self, node: int, heap: list[tuple], max_hops: int) -> list:
        """A node's steps; with them come those of the best nodes that the heap holds."""
        if node not in self.held:
            near = [entry[1] for entry in heapq.nsmallest(4 * FETCHED_AT_ONCE, heap) if len(entry[5]) < max_hops]
            nodes = list(dict.fromkeys([node, *[n for n in near if n not in self.held]]))[:FETCHED_AT_ONCE]
            self.held.update({n: [] for n in nodes})
            for r in self.moves.where(F.col("node").isin(nodes)).orderBy("node", "direction", "edge").toLocalIterator():
                self.held[r["node"]].append((r["neighbor"], r["edge"], r["neighbor_score"], r["edge_score"], r["degree"]))
        return self.held.pop(node)


def best_first(seeds: list[tuple[int, float]], moves: dict[int, list[tuple[int, int, float, float, int]]] | Fetched, o: SemanticPathOptions) -> list[tuple]:
    """The expansion itself.  ``moves``: (neighbor, edge, node score, edge score, degree) by node, out-edges first."""
    heap: list[tuple] = []
    best: dict[int, float] = {}
    result: dict[int, tuple] = {}
    order = 0
    for node, score in seeds:
        heapq.heappush(heap, (-score, node, order, node, score, ()))
        best[node] = max(score, best.get(node, -math.inf))
        order += 1
    expansions = 0
    while heap:
        minus, node, _, seed, seed_score, path = heapq.heappop(heap)
        score = -minus
        if score < best.get(node, -math.inf):
            continue
        if path or o.include_seeds:
            result[node] = (seed, node, score, seed_score, list(path))
        if len(path) >= o.max_hops or expansions >= o.max_expansions:
            continue
        expansions += 1
        for neighbor, edge, node_score, edge_score, degree in moves.wanted(node, heap, o.max_hops) if isinstance(moves, Fetched) else moves.get(node, ()):
            if edge in path:
                continue
            meaning = (o.node_weight * node_score + o.edge_weight * edge_score) / (o.node_weight + o.edge_weight)
            value = (o.path_decay * score + (1 - o.path_decay) * meaning) * o.hop_penalty - o.degree_penalty * math.log1p(degree)
            if value > best.get(neighbor, -math.inf):
                best[neighbor] = value
                heapq.heappush(heap, (-value, neighbor, order, seed, seed_score, (*path, edge)))
                order += 1
    return sorted(result.values(), key=lambda r: (-r[2], r[1]))[: o.limit]


def semantic_paths(graph: Graph, query, options: SemanticPathOptions = SemanticPathOptions(), starts: list[int] | None = None) -> DataFrame:
    """Paths from the nodes nearest to a vector (or from given ones), best first: rank, seed, node, score, seed_score, path."""
    options.check()
    prepared = vectors.prepared_query(graph, query)
    if starts is None:
        hits, _ = sketch.vector_search_adaptive(graph, query, options.seed_count, NODES, options.seed_label)
        seeds = hits.orderBy("rank").select("id", "score")
    else:
        filters.require_nodes(graph, starts)
        mine = graph.vectors_of(NODES).where(F.col("id").isin(starts))
        seeds = vectors.best_facets(mine, prepared[None]).select("id", F.col("q0.score").alias("score")).orderBy("id")
    seed_rows = [(r[0], r[1]) for r in seeds.collect()]  # at most seed_count, or as many as were given
    if not seed_rows:
        return graph.spark.createDataFrame([], f"rank int, {PATH_DDL}")
    roots = filters.element_set(graph, [i for i, _ in seed_rows])
    near = write_table(traverse.nodes_within_hops(graph, roots, options.max_hops, options.direction, options.edge_label).select("id"), "near")
    walk = steps(graph, options.direction, options.edge_label).join(near.withColumnRenamed("id", "node"), "node", "left_semi")
    walk = walk.join(near.withColumnRenamed("id", "neighbor"), "neighbor", "left_semi").select("node", "direction", "neighbor", "edge")

    def element_scores(kind: int, ids: DataFrame, name: str) -> DataFrame:
        mine = graph.vectors_of((kind,)).join(ids.distinct(), "id", "left_semi")
        return vectors.best_facets(mine, prepared[None]).select(F.col("id").alias(name), F.col("q0.score").alias(f"{name}_score"))

    degree = steps(graph, BOTH).join(near.withColumnRenamed("id", "node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree")).withColumnRenamed("node", "neighbor")
    scored = walk.join(element_scores(EDGE, walk.select(F.col("edge").alias("id")), "edge"), "edge")
    scored = scored.join(element_scores(NODE, near, "neighbor"), "neighbor").join(degree, "neighbor")
    moves, n = write_counted(scored.select(F.lit(0).alias("query"), "node", "direction", "neighbor", "edge", "neighbor_score", "edge_score", "degree"), "moves")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table: dict[int, list] = {}
        for r in pdf.sort_values(["node", "direction", "edge"]).itertuples(index=False):
            table.setdefault(r.node, []).append((r.neighbor, r.edge, r.neighbor_score, r.edge_score, r.degree))
        found = best_first(seed_rows, table, options)
        return pd.DataFrame([(i + 1, *r) for i, r in enumerate(found)], columns=["rank", "seed", "node", "score", "seed_score", "path"])

    if n > options.gathered_edges:
        placed = write_table(moves.repartitionByRange(partitions_for(moves), "node").sortWithinPartitions("node"), "moves_by_node")
        found = best_first(seed_rows, Fetched(placed), options)
        return graph.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(found)], f"rank int, {PATH_DDL}")
    if n == 0:
        found = best_first(seed_rows, {}, options)
        return graph.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(found)], f"rank int, {PATH_DDL}")
    return moves.groupBy("query").applyInPandas(run, f"rank int, {PATH_DDL}")
