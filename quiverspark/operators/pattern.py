"""One-hop patterns: the query language, its matching and the semantic form."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverspark.graph import Graph
from quiverspark.model import BOTH, IN, NODES, OUT, InvalidArgument
from quiverspark.operators import filters, sketch, vectors
from quiverspark.operators.filters import ElementFilter, steps
from quiverspark.plans import planner

DEFAULT_LIMIT = 100


@dataclass(frozen=True)
class OneHop:
    """(start)-[edge]->(end) with filters on both nodes and a label on the edge."""

    start: ElementFilter = ElementFilter()
    edge_label: str | None = None
    end: ElementFilter = ElementFilter()
    direction: str = OUT
    limit: int = DEFAULT_LIMIT


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_PATTERN = re.compile(
    rf"\s*MATCH\s*\(\s*(?P<a>{_NAME})\s*(?::\s*(?P<a_label>{_NAME})\s*)?\)\s*(?P<left><)?\s*-?\s*\[\s*(?P<e>{_NAME})\s*(?::\s*(?P<e_label>{_NAME})\s*)?\]\s*-\s*(?P<right>>)?\s*"
    rf"\(\s*(?P<b>{_NAME})\s*(?::\s*(?P<b_label>{_NAME})\s*)?\)\s*RETURN\s+.+?(?:\s+LIMIT\s+(?P<limit>[0-9]+))?\s*;?\s*",
    re.IGNORECASE | re.ASCII | re.DOTALL,
)


def parse(text: str) -> OneHop:
    """``MATCH (a:L)-[e:T]->(b:M) RETURN ... LIMIT n``; keywords in any case, labels as written."""
    m = _PATTERN.fullmatch(text)
    if not m:
        raise InvalidArgument("expected MATCH (a[:Label])-[e[:TYPE]]->(b[:Label]) RETURN ... [LIMIT n]")
    if m["left"] and m["right"]:
        raise InvalidArgument("a relationship can't point both ways")
    direction = IN if m["left"] else OUT if m["right"] else BOTH
    return OneHop(ElementFilter(m["a_label"]), m["e_label"], ElementFilter(m["b_label"]), direction, DEFAULT_LIMIT if m["limit"] is None else int(m["limit"]))


def plan(graph: Graph, query: OneHop) -> planner.OneHopPlan:
    start = filters.element_filter_plan(graph, query.start, NODES).upper_bound
    end = filters.element_filter_plan(graph, query.end, NODES).upper_bound
    return planner.one_hop_plan(graph, query.edge_label, start, end, query.direction)


def _oriented(graph: Graph, query: OneHop) -> DataFrame:
    """(start, edge, end) in the asked direction; an undirected edge both ways, a self-loop once."""
    found = graph.edges if query.edge_label is None else graph.edges.where(F.col("label") == query.edge_label)
    out = found.select(F.col("source").alias("start"), F.col("id").alias("edge"), F.col("target").alias("end"))
    back = found.select(F.col("target").alias("start"), F.col("id").alias("edge"), F.col("source").alias("end"))
    if query.direction == OUT:
        return out
    return back if query.direction == IN else out.unionByName(back.where("start <> end"))


def _only(frame: DataFrame, graph: Graph, column: str, wanted: ElementFilter) -> DataFrame:
    """Rows whose node satisfies a filter; a filter that asks nothing costs no join."""
    if wanted == ElementFilter():
        return frame
    return frame.join(graph.nodes.where(wanted.condition()).select(F.col("id").alias(column)), column, "left_semi")


def _from_end(graph: Graph, query: OneHop, at: str) -> DataFrame:
    """(start, edge, end) by walking the adjacency from the nodes of the filter at one end."""
    wanted = query.start if at == "start" else query.end
    nodes = graph.nodes.where(wanted.condition()).select(F.col("id").alias("node"))
    direction = query.direction if at == "start" else {OUT: IN, IN: OUT, BOTH: BOTH}[query.direction]
    met = steps(graph, direction, query.edge_label).join(nodes, "node", "left_semi")
    other = "end" if at == "start" else "start"
    return met.select(F.col("node").alias(at), "edge", F.col("neighbor").alias(other))


def matches(graph: Graph, query: OneHop, chosen: planner.OneHopPlan | None = None) -> DataFrame:
    """All matches of a pattern: start, edge, end, in the way of the plan.

    From a selective end the walk goes over the adjacency, which is bucketed by node, so only
    that end's nodes are shuffled; otherwise the edges are scanned once.
    """
    chosen = plan(graph, query) if chosen is None else chosen
    if chosen.strategy == "edge_scan":
        return _only(_only(_oriented(graph, query), graph, "start", query.start), graph, "end", query.end).select("start", "edge", "end")
    at, other, wanted = ("start", "end", query.end) if chosen.strategy == "start_adjacency" else ("end", "start", query.start)
    return _only(_from_end(graph, query, at), graph, other, wanted).select("start", "edge", "end")


def match_one_hop(graph: Graph, query: OneHop) -> DataFrame:
    """The first ``limit`` matches by edge, start and end."""
    return matches(graph, query).orderBy("edge", "start", "end").limit(query.limit)


def query(graph: Graph, text: str) -> DataFrame:
    """Run a pattern; an unknown label gives no rows."""
    return match_one_hop(graph, parse(text))


def hydrated(graph: Graph, found: DataFrame) -> DataFrame:
    """Matches with the labels and properties of their elements."""
    node = lambda c: graph.nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"), F.col("props").alias(f"{c}_props"))
    edge = graph.edges.select(F.col("id").alias("edge"), F.col("label").alias("edge_label"), F.col("props").alias("edge_props"))
    return found.join(node("start"), "start").join(edge, "edge").join(node("end"), "end")


# --- semantic form -----------------------------------------------------------------------


def _scores(graph: Graph, prepared: np.ndarray, kind: int, ids: DataFrame) -> DataFrame:
    """(id, score) of the best facet of given elements."""
    mine = graph.vectors_of((kind,)).join(ids.select("id").distinct(), "id", "left_semi")
    best = vectors.best_facets(mine, prepared[None])
    return best.select("id", F.col("q0.score").alias("score"))


def match_semantic_one_hop(graph: Graph, vector, query: OneHop, seed_count: int = 64, start_weight: float = 0.5, edge_weight: float = 0.25, end_weight: float = 0.25) -> DataFrame:
    """Patterns around the starts nearest to a vector, by the weighted mean of the scores that exist.

    Seeds are chosen by the start's label alone; its properties are asked afterwards, so
    fewer rows may come back than the graph holds.
    """
    if seed_count == 0:
        raise InvalidArgument("a semantic pattern needs seeds")
    weights = (start_weight, edge_weight, end_weight)
    if not np.isfinite(weights).all() or start_weight <= 0 or min(edge_weight, end_weight) < 0:
        raise InvalidArgument("weights must be finite and not negative, the start's positive")
    prepared = vectors.prepared_query(graph, vector)
    hits, _ = sketch.vector_search_adaptive(graph, vector, seed_count, NODES, query.start.label)
    seeds = hits.select(F.col("id").alias("start"), F.col("score").alias("start_score"))
    walk = steps(graph, query.direction, query.edge_label).select(F.col("node").alias("start"), "edge", F.col("neighbor").alias("end"))
    found = _only(_only(walk.join(F.broadcast(seeds), "start"), graph, "start", query.start), graph, "end", query.end)
    edge_scores = _scores(graph, prepared, 1, found.select(F.col("edge").alias("id"))).select(F.col("id").alias("edge"), F.col("score").alias("edge_score"))
    end_scores = _scores(graph, prepared, 0, found.select(F.col("end").alias("id"))).select(F.col("id").alias("end"), F.col("score").alias("end_score"))
    full = found.join(edge_scores, "edge", "left").join(end_scores, "end", "left")
    total = F.lit(start_weight) + F.when(F.col("edge_score").isNotNull(), edge_weight).otherwise(0.0) + F.when(F.col("end_score").isNotNull(), end_weight).otherwise(0.0)
    weighted = F.col("start_score") * start_weight + F.coalesce(F.col("edge_score") * edge_weight, F.lit(0.0)) + F.coalesce(F.col("end_score") * end_weight, F.lit(0.0))
    told = full.select("start", "edge", "end", F.round(weighted / total, vectors.DIGITS).alias("score"), "start_score", "edge_score", "end_score")
    return told.orderBy(F.desc("score"), "start", "edge", "end").limit(query.limit)


def query_text(graph: Graph, text: str, embed, words: str) -> DataFrame:
    """A pattern whose starts are found by an embedded text; seeds follow the limit."""
    pattern = parse(text)
    return match_semantic_one_hop(graph, embed(words, graph.dimension), pattern, seed_count=max(64, min(4096, 8 * pattern.limit)))


def concise(elements: DataFrame, keys: Sequence[str] = ("name", "title", "path", "text", "kind")) -> DataFrame:
    """Elements with the first of some properties as ``concise``."""
    from quiverspark.model import label_text

    return elements.withColumn("concise", F.coalesce(*[label_text(F.col("props")[k]) for k in keys]))
