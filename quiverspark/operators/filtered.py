"""Filter-first vector search: scalar predicates narrow the candidates, then the search is planned."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quiverspark.graph import Graph
from quiverspark.model import BOTH_KINDS, EDGES, NODES
from quiverspark.operators import filters, sketch, vectors
from quiverspark.plans import planner


@dataclass(frozen=True)
class FilteredResult:
    hits: DataFrame
    candidate_elements: int
    equality_plan: planner.FilterPlan | None
    range_plans: tuple[planner.FilterPlan, ...]
    vector_plan: planner.VectorPlan


def vector_search_filtered(graph: Graph, query: Sequence[float], k: int, equality: filters.ElementFilter | None = None, ranges: Sequence[filters.Range] = (), target: tuple[int, ...] = BOTH_KINDS) -> FilteredResult:
    """Search among the elements that satisfy every predicate.

    Bounds of all predicates are counted in one pass; the sets are then evaluated from the
    cheapest on, each among what the earlier ones left, and written, so neither the count nor
    the search evaluates a predicate again.  Where nothing is left, nothing is searched.
    """
    if equality is None and not ranges:
        hits, plan = sketch.vector_search_adaptive(graph, query, k, target)
        total = sum(n for kind, n in ((0, graph.node_count), (1, graph.edge_count)) if kind in target)
        return FilteredResult(hits, total, None, (), plan)
    found, bounds, left = filters.narrowed(graph, equality, ranges, target)
    n_equal = 0 if equality is None else len(equality.properties)
    equality_plan = planner.element_filter_plan(graph, target, equality.label, bounds[:n_equal]) if equality is not None else None
    range_plans = tuple(planner.numeric_range_plan(graph, target, r.label, n) for r, n in zip(ranges, bounds[n_equal:], strict=True))
    counted = (0, 0) if not left[-1] else (left[-1], 0) if target == NODES else (0, left[-1]) if target == EDGES else filters.sizes(found)
    if not left[-1]:
        vectors.prepared_query(graph, query)
        empty = graph.spark.createDataFrame([], "kind tinyint, id bigint, facet int, score double, rank int")
        return FilteredResult(empty, 0, equality_plan, range_plans, planner.vector_search_within_plan(graph, 0, 0))
    hits, plan = sketch.vector_search_within_adaptive(graph, query, found, k, counted)
    return FilteredResult(hits, left[-1], equality_plan, range_plans, plan)
