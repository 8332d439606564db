"""The graph handle: frames of nodes, edges, vectors and adjacency, with the operators as methods."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark import model
from quiverspark.model import EDGE, NODE

COSINE, DOT = "cosine", "dot"


@dataclass
class Graph:
    """A labelled property multigraph in which nodes and edges own any number of vectors.

    ``nodes``, ``edges`` and ``vectors`` follow the schemas of ``quiverspark.model``.
    ``adjacency``, ``sketch`` and ``props`` are derived where they are not given; a stored
    graph brings them along, the adjacency bucketed by node, the properties flat and sorted
    by key and value.  ``logged`` are the elements (kind, id) that transactions put since the base.
    """

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    dimension: int
    similarity: str = COSINE
    adjacency_table: DataFrame | None = None
    sketch_table: DataFrame | None = None
    props_table: DataFrame | None = None
    transactions: int = 0
    logged: DataFrame | None = None
    buckets: int | None = None
    counts: dict[str, Any] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @cached_property
    def adjacency(self) -> DataFrame:
        """Both directions of every edge: node, direction (0 out, 1 in), neighbor, edge, label."""
        return self.adjacency_table if self.adjacency_table is not None else adjacency_of(self.edges)

    @cached_property
    def sketch(self) -> DataFrame:
        from quiverspark.operators import sketch

        return self.sketch_table if self.sketch_table is not None else sketch.sketch_of(self.vectors, self.dimension)

    @cached_property
    def props(self) -> DataFrame:
        """One row for each element and key: kind, id, label, key and the value's fields."""
        return self.props_table if self.props_table is not None else props_of(self.elements)

    @cached_property
    def elements(self) -> DataFrame:
        """kind, id, label and props of nodes and edges."""
        nodes = self.nodes.select(F.lit(NODE).cast("tinyint").alias("kind"), "id", "label", "props")
        return nodes.unionByName(self.edges.select(F.lit(EDGE).cast("tinyint").alias("kind"), "id", "label", "props"))

    def elements_of(self, target: tuple[int, ...]) -> DataFrame:
        """Elements of the asked kinds; a kind that is not asked for is not read."""
        if target == model.BOTH_KINDS:
            return self.elements
        frame = self.nodes if target == model.NODES else self.edges
        return frame.select(F.lit(target[0]).cast("tinyint").alias("kind"), "id", "label", "props")

    def edges_of(self, *labels: str) -> DataFrame:
        return self.edges.where(F.col("label").isin(*labels))

    def vectors_of(self, target: tuple[int, ...], label: str | None = None) -> DataFrame:
        """Vectors of the asked kinds and label; others are not read."""
        found = self.vectors if target == model.BOTH_KINDS else self.vectors.where(F.col("kind").isin(*target))
        return found if label is None else found.where(F.col("label") == label)

    def sketch_of(self, target: tuple[int, ...]) -> DataFrame:
        return self.sketch if target == model.BOTH_KINDS else self.sketch.where(F.col("kind").isin(*target))

    def has_vectors(self, kind: int) -> bool:
        return not self.vectors_of((kind,)).isEmpty()

    def props_of(self, target: tuple[int, ...], *keys: str) -> DataFrame:
        """Flat properties of the asked kinds and keys."""
        found = self.props.where(F.col("key").isin(*keys))
        return found if target == model.BOTH_KINDS else found.where(F.col("kind") == target[0])

    def props_tagged(self, target: tuple[int, ...], *tags: int) -> DataFrame:
        """Flat properties of the asked kinds whose values have one of some types."""
        found = self.props.where(F.col("tag").isin(*tags))
        return found if target == model.BOTH_KINDS else found.where(F.col("kind") == target[0])

    @property
    def links(self) -> DataFrame:
        """The adjacency for one whole pass: the stored one, or where there is none yet the edges both ways."""
        return self.adjacency

    @property
    def ends(self) -> DataFrame:
        """source and target of every edge, for what needs no ids."""
        return self.edges.select("source", "target")

    def count(self, name: str) -> Any:
        """Counts that planners need, taken once per handle: by label for ``nodes`` and ``edges``; vectors and
        their owners by kind for ``vectors``, by kind and label for ``labelled``."""
        if name not in self.counts:
            if name in ("nodes", "edges"):
                frame = self.nodes if name == "nodes" else self.edges
                self.counts[name] = {r[0]: r[1] for r in frame.groupBy("label").count().collect()}
            else:  # an element has one label, so owners by label add up
                rows = self.vectors.groupBy("kind", "label").agg(F.count("*"), F.countDistinct("id")).collect()
                self.counts["labelled"] = {(r[0], r[1]): (r[2], r[3]) for r in rows}
                self.counts["vectors"] = {k: (sum(r[2] for r in rows if r[0] == k), sum(r[3] for r in rows if r[0] == k)) for k in {r[0] for r in rows}}
        return self.counts[name]

    @property
    def node_count(self) -> int:
        return sum(self.count("nodes").values())

    @property
    def edge_count(self) -> int:
        return sum(self.count("edges").values())


def props_of(elements: DataFrame) -> DataFrame:
    each = elements.select("kind", "id", "label", F.explode("props").alias("key", "value"))
    return each.select("kind", "id", "label", "key", "value.tag", "value.i", "value.f", "value.s", "value.x")


def adjacency_of(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("source").alias("node"), F.lit(0).cast("tinyint").alias("direction"), F.col("target").alias("neighbor"), F.col("id").alias("edge"), "label")
    back = edges.select(F.col("target").alias("node"), F.lit(1).cast("tinyint").alias("direction"), F.col("source").alias("neighbor"), F.col("id").alias("edge"), "label")
    return out.unionByName(back)
