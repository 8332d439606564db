"""Point reads, scalar predicates and sets of elements.

A set is a frame of (kind, id) without repeats.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverspark import model
from quiverspark.graph import Graph
from quiverspark.model import BOTH, BOTH_KINDS, FLOAT, IN, INT, NODE, OUT, InvalidArgument, NotFound
from quiverspark.plans import planner
from quiverspark.plans.workspace import write_counted

# --- point reads -------------------------------------------------------------------------


def node(graph: Graph, identifier: int) -> DataFrame:
    """The node's record, or no row."""
    return graph.nodes.where(F.col("id") == identifier)


def edge(graph: Graph, identifier: int) -> DataFrame:
    """The edge's record, or no row."""
    return graph.edges.where(F.col("id") == identifier)


def node_ids(graph: Graph) -> DataFrame:
    return graph.nodes.select("id").orderBy("id")


def edge_ids(graph: Graph) -> DataFrame:
    return graph.edges.select("id").orderBy("id")


def vector(graph: Graph, kind: int, identifier: int, facet: int = 0) -> DataFrame:
    """One facet, or no row where it is out of range."""
    return graph.vectors_of((kind,)).where((F.col("id") == identifier) & (F.col("facet") == facet))


def symbols(graph: Graph) -> DataFrame:
    """Distinct labels and property keys: one dictionary for both."""
    labels = graph.elements.select(F.col("label").alias("symbol"))
    keys = graph.elements.select(F.explode(F.map_keys("props")).alias("symbol"))
    return labels.unionByName(keys).distinct()


def nodes_with_label(graph: Graph, label: str) -> DataFrame:
    """Nodes of a label, largest id first."""
    return graph.nodes.where(F.col("label") == label).orderBy(F.desc("id"))


def property_of(elements: DataFrame, key: str) -> DataFrame:
    """Elements with the key's value as column ``value``; null where the key is missing."""
    return elements.withColumn("value", F.col("props")[key])


def require_nodes(graph: Graph, ids: list[int]) -> None:
    held = {r[0] for r in graph.nodes.where(F.col("id").isin(ids)).select("id").collect()} if ids else set()
    for i in ids:
        if i not in held:
            raise NotFound("node", i)


def directions(direction: str) -> Column:
    if direction not in (OUT, IN, BOTH):
        raise InvalidArgument(f"direction {direction!r}")
    return F.lit(True) if direction == BOTH else F.col("direction") == (0 if direction == OUT else 1)


def steps(graph: Graph, direction: str, label: str | None = None, once: bool = False) -> DataFrame:
    """Adjacency in one or both directions; a self-loop is met once from its node.

    What walks ``once`` over all of it needs no adjacency by node and does not cause one to be stored."""
    wanted = (graph.links if once else graph.adjacency).where(directions(direction))
    if label is not None:
        wanted = wanted.where(F.col("label") == label)
    return wanted.where("NOT (direction = 1 AND node = neighbor)") if direction == BOTH else wanted


def visit_neighbors(graph: Graph, identifier: int, direction: str = BOTH, label: str | None = None) -> DataFrame:
    """(neighbor, edge) of a node, out-edges before in-edges."""
    require_nodes(graph, [identifier])
    found = steps(graph, direction, label).where(F.col("node") == identifier)
    return found.orderBy("direction", "edge").select("neighbor", "edge")


FEW_IDS = 1000


def neighbors(graph: Graph, identifier: int, direction: str = BOTH, label: str | None = None) -> DataFrame:
    """Edges at a node, out-edges first, each once.

    The adjacency, of which one bucket is read, names the edges; up to ``FEW_IDS`` of them
    are pushed to the files of the edges as a list, more are joined.
    """
    require_nodes(graph, [identifier])
    met = steps(graph, direction, label).where(F.col("node") == identifier).select(F.col("edge").alias("id"))
    few = [r[0] for r in met.limit(FEW_IDS + 1).collect()]
    found = graph.edges.where(F.col("id").isin(few)) if len(few) <= FEW_IDS else graph.edges.join(met, "id", "left_semi")
    return found.orderBy("id") if direction == IN else found.orderBy(F.when(F.col("source") == identifier, 0).otherwise(1), "id")


def degrees(graph: Graph, direction: str = BOTH) -> DataFrame:
    """(node, degree) of every node: distinct incident edges, a self-loop once."""
    counted = steps(graph, direction, once=True).groupBy("node").agg(F.count("*").alias("degree"))
    return graph.nodes.select(F.col("id").alias("node")).join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


# --- predicates --------------------------------------------------------------------------


@dataclass(frozen=True)
class ElementFilter:
    """A label, if any, and property equalities that all must hold."""

    label: str | None = None
    properties: tuple[tuple[str, Any], ...] = ()

    def condition(self) -> Column:
        """Over elements with their property maps."""
        wanted = F.lit(True) if self.label is None else F.col("label") == self.label
        for key, value in self.properties:
            wanted &= model.equals(F.col("props")[key], value)
        return wanted

    def sets(self, graph: Graph, target: tuple[int, ...]) -> list[DataFrame]:
        """A set for each property, or one for the label alone; each a scan of the flat table."""
        if not self.properties:
            found = graph.elements_of(target)
            return [(found if self.label is None else found.where(F.col("label") == self.label)).select("kind", "id")]
        return [_flat(graph, target, self.label, key).where(model.equals(_value(), value)).select("kind", "id") for key, value in self.properties]


def _value() -> Column:
    """The value of a row of the flat table of properties."""
    return F.struct("tag", "i", "f", "s", "x")


def _flat(graph: Graph, target: tuple[int, ...], label: str | None, key: str) -> DataFrame:
    """Rows of one key: simple comparisons only, which Parquet's statistics can answer."""
    found = graph.props_of(target, key)
    return found if label is None else found.where(F.col("label") == label)


def _all_of(sets: list[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = intersection(out, s)
    return out


@dataclass(frozen=True)
class Range:
    """A numeric interval on a key; bounds are None, or a number with whether it belongs to the interval."""

    key: str
    lower: float | int | None = None
    upper: float | int | None = None
    label: str | None = None
    lower_inclusive: bool = True
    upper_inclusive: bool = True
    tag: int = field(init=False, default=0)

    def __post_init__(self):
        bounds = [b for b in (self.lower, self.upper) if b is not None]
        if not bounds:
            raise InvalidArgument("a range needs a bound")
        if any(isinstance(b, float) and math.isnan(b) for b in bounds):
            raise InvalidArgument("a range bound can't be NaN")
        if len({isinstance(b, float) for b in bounds}) > 1:
            raise InvalidArgument("range bounds must be of one type")
        object.__setattr__(self, "tag", FLOAT if isinstance(bounds[0], float) else INT)

    def condition(self, value: Column | None = None) -> Column:
        """Over elements with their property maps, or over given values."""
        value = F.col("props")[self.key] if value is None else value
        number = value["f"] if self.tag == FLOAT else value["i"]
        wanted = value["tag"] == self.tag
        if self.tag == FLOAT:
            wanted &= ~F.isnan(number)
        if self.lower is not None:
            wanted &= number >= F.lit(self.lower) if self.lower_inclusive else number > F.lit(self.lower)
        if self.upper is not None:
            wanted &= number <= F.lit(self.upper) if self.upper_inclusive else number < F.lit(self.upper)
        if self.label is not None:
            wanted &= F.col("label") == self.label
        return wanted


def elements_with_label(graph: Graph, label: str, target: tuple[int, ...] = BOTH_KINDS) -> DataFrame:
    return graph.elements_of(target).where(F.col("label") == label).select("kind", "id")


def elements_matching(graph: Graph, wanted: ElementFilter, target: tuple[int, ...] = BOTH_KINDS) -> DataFrame:
    """Elements with the label and all property values."""
    return _all_of(wanted.sets(graph, target))


def elements_in_range(graph: Graph, wanted: Range, target: tuple[int, ...] = BOTH_KINDS) -> DataFrame:
    """Elements whose value has the range's own type and lies in it."""
    return _flat(graph, target, wanted.label, wanted.key).where(wanted.condition(_value())).select("kind", "id")


@dataclass(frozen=True)
class Predicate:
    """One condition on one key of the flat table: an equality of a filter, or a range."""

    key: str
    condition: Column
    label: str | None


def _predicates(equality: ElementFilter | None, ranges: Sequence[Range]) -> list[Predicate]:
    equal = [] if equality is None else [Predicate(k, model.equals(_value(), v), equality.label) for k, v in equality.properties]
    return equal + [Predicate(r.key, r.condition(_value()), r.label) for r in ranges]


def elements_satisfying(graph: Graph, equality: ElementFilter | None, ranges: Sequence[Range], target: tuple[int, ...] = BOTH_KINDS) -> DataFrame:
    """Elements that pass an equality filter and all ranges."""
    return narrowed(graph, equality, ranges, target)[0]


def bounds_of(graph: Graph, predicates: Sequence[Predicate], target: tuple[int, ...]) -> list[int]:
    """How many elements satisfy each predicate, in one pass over the rows of their keys."""
    if not predicates:
        return []
    found = graph.props_of(target, *sorted({p.key for p in predicates}))
    return list(found.agg(*[F.count_if((F.col("key") == p.key) & p.condition).alias(f"p{i}") for i, p in enumerate(predicates)]).first())


#: Elements of a set up to which it is broadcast: two numbers each.
BROADCAST_ELEMENTS = 1 << 20


def narrowed(graph: Graph, equality: ElementFilter | None, ranges: Sequence[Range], target: tuple[int, ...] = BOTH_KINDS) -> tuple[DataFrame, list[int], list[int]]:
    """Elements that pass an equality filter and all ranges, with the bounds of the predicates and the sizes
    that were left after each.

    The predicate with the smallest bound is evaluated first and written with its size; each
    other one is asked of what is left, and nothing more is read once nothing is left.
    """
    predicates = _predicates(equality, ranges)
    bounds = bounds_of(graph, predicates, target)
    left, sizes_left = None, []
    for i in sorted(range(len(predicates)), key=lambda i: (bounds[i], i)):
        p = predicates[i]
        found = _flat(graph, target, p.label, p.key).where(p.condition).select("kind", "id")
        if left is not None:
            small = F.broadcast(left) if sizes_left[-1] <= BROADCAST_ELEMENTS else left
            found = found.join(small, SET, "left_semi")
        left, n = write_counted(found, "candidates")
        sizes_left.append(n)
        if not n:
            break
    if equality is not None and not equality.properties and (left is None or sizes_left[-1]):
        alike = equality.sets(graph, target)[0]
        left, n = write_counted(alike if left is None else alike.join(F.broadcast(left) if sizes_left[-1] <= BROADCAST_ELEMENTS else left, SET, "left_semi"), "candidates")
        sizes_left.append(n)
    return left, bounds, sizes_left


def predicate_counts(graph: Graph, wanted: ElementFilter, target: tuple[int, ...]) -> list[int]:
    """How many elements satisfy each property predicate alone, in one pass."""
    return bounds_of(graph, [Predicate(p.key, p.condition, None) for p in _predicates(wanted, ())], target)


def element_filter_plan(graph: Graph, wanted: ElementFilter, target: tuple[int, ...] = BOTH_KINDS) -> planner.FilterPlan:
    return planner.element_filter_plan(graph, target, wanted.label, predicate_counts(graph, wanted, target))


def numeric_range_plan(graph: Graph, wanted: Range, target: tuple[int, ...] = BOTH_KINDS) -> planner.FilterPlan:
    alone = Range(wanted.key, wanted.lower, wanted.upper, None, wanted.lower_inclusive, wanted.upper_inclusive)
    return planner.numeric_range_plan(graph, target, wanted.label, elements_in_range(graph, alone, target).count())


def numeric_range(graph: Graph, wanted: Range, limit: int, target: tuple[int, ...] = BOTH_KINDS) -> DataFrame:
    """The first elements in a range, nodes before edges."""
    return elements_in_range(graph, wanted, target).orderBy("kind", "id").limit(limit)


# --- sets --------------------------------------------------------------------------------

SET = ["kind", "id"]


def element_set(graph: Graph, nodes: list[int] = (), edges: list[int] = ()) -> DataFrame:
    """A set from given ids."""
    rows = sorted({(model.NODE, i) for i in nodes} | {(model.EDGE, i) for i in edges})
    return graph.spark.createDataFrame(rows, "kind tinyint, id bigint")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*SET).unionByName(b.select(*SET)).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*SET).join(b.select(*SET), SET, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*SET).join(b.select(*SET), SET, "left_anti")


def insert(a: DataFrame, kind: int, identifier: int) -> DataFrame:
    return union(a, a.sparkSession.createDataFrame([(kind, identifier)], "kind tinyint, id bigint"))


def remove(a: DataFrame, kind: int, identifier: int) -> DataFrame:
    return a.where(~((F.col("kind") == kind) & (F.col("id") == identifier)))


def contains(a: DataFrame, kind: int, identifier: int) -> bool:
    return not a.where((F.col("kind") == kind) & (F.col("id") == identifier)).isEmpty()


def sizes(a: DataFrame) -> tuple[int, int]:
    """Nodes and edges of a set, in one pass."""
    row = a.agg(F.count_if(F.col("kind") == NODE), F.count_if(F.col("kind") != NODE)).first()
    return row[0], row[1]


def ascending(a: DataFrame) -> DataFrame:
    return a.select(*SET).orderBy(*SET)


# --- counts ------------------------------------------------------------------------------


def label_counts(graph: Graph) -> DataFrame:
    """Nodes by label, most frequent first."""
    return graph.nodes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def relationship_counts(graph: Graph) -> DataFrame:
    """Edges by label, most frequent first."""
    return graph.edges.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
