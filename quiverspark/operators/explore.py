"""Exploration: lexical and hybrid search, bounded snapshots and focus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverspark import model
from quiverspark.functions import embedding
from quiverspark.functions.text import ascii_lower, clipped, score_text
from quiverspark.graph import Graph
from quiverspark.model import BOTH_KINDS, InvalidArgument, label_text
from quiverspark.operators import sketch
from quiverspark.operators.filters import BOTH, steps
from quiverspark.operators.vectors import DIGITS
from quiverspark.plans.workspace import write_table
from quiverspark.sources.rows import numbered

#: Keys by weight, weights of labels and signals, and text lengths.
TITLE_KEYS = ["title", "name", "headline", "path", "tag_name", "login"]
BODY_KEYS = ["body", "description", "message", "url"]
DETAIL_KEYS = ["body", "description", "message", "url", "state", "kind"]
LABEL_WEIGHT, TITLE_WEIGHT, BODY_WEIGHT, OTHER_WEIGHT = 1.2, 1.5, 0.85, 0.55
LEXICAL_SHARE, SEMANTIC_SHARE = 0.46, 0.54
TITLE_CHARACTERS, DETAIL_CHARACTERS = 92, 132
TEXT, SEMANTIC, HYBRID = "text", "semantic", "hybrid"


#: Types of values that have a text at all, and those whose text is no number.
TEXT_TAGS = (model.STRING, model.TRUE, model.FALSE)
TAGS = (*TEXT_TAGS, model.INT, model.FLOAT, model.NODE_REF, model.EDGE_REF)


def _never_in_numbers(words: list[str]) -> bool:
    """Whether no number's text can hold any of the words: each has a character that numbers are never written with."""
    return all(set(w) - set("0123456789.+-einfinitynan") for w in words)


def _scored_labels(graph: Graph, phrase: str, terms: list[str], target: tuple[int, ...]) -> DataFrame:
    """kind, id, score of elements whose label has a score; labels are few, so each is scored once and then looked for."""
    found = graph.spark.createDataFrame([], "kind tinyint, id bigint, score double")
    for kind, name in ((model.NODE, "nodes"), (model.EDGE, "edges")):
        labels = [(x,) for x in graph.count(name) if x is not None] if kind in target else []
        if not labels:
            continue
        told = graph.spark.createDataFrame(labels, "label string").select("label", score_text(ascii_lower(F.col("label")), phrase, terms, LABEL_WEIGHT).alias("score")).where("score > 0").collect()
        if told:
            frame = graph.nodes.where(F.col("label").isin([r[0] for r in told])) if kind == model.NODE else graph.edges_of(*[r[0] for r in told])
            score = F.create_map(*[F.lit(x) for r in told for x in r])[F.col("label")]
            found = found.unionByName(frame.select(F.lit(kind).cast("tinyint").alias("kind"), "id", score.alias("score")))
    return found


def lexical_search(graph: Graph, words: str, limit: int, target: tuple[int, ...] = BOTH_KINDS) -> DataFrame:
    """Elements by lexical score of label and properties: kind, id, score.  No score, no row."""
    phrase = embedding.ascii_lower(words)
    terms = [t for t in embedding.tokens(phrase) if t]
    weight = F.when(F.col("key").isin(TITLE_KEYS), TITLE_WEIGHT).when(F.col("key").isin(BODY_KEYS), BODY_WEIGHT).otherwise(OTHER_WEIGHT)
    label = _scored_labels(graph, phrase, terms, target)
    props = graph.props_tagged(target, *(TEXT_TAGS if _never_in_numbers([phrase, *terms]) else TAGS))
    text = ascii_lower(label_text(F.struct("tag", "i", "f", "s", "x")))
    found = props.select("kind", "id", score_text(text, phrase, terms, weight).alias("score"))
    both = label.unionByName(found.where("score > 0"))
    total = both.groupBy("kind", "id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return total.orderBy(F.desc("score"), "kind", "id").limit(limit)


@dataclass(frozen=True)
class HybridResult:
    hits: DataFrame
    warning: str | None


def hybrid_search(graph: Graph, words: str, limit: int = 10, mode: str = HYBRID, embed: Callable | None = None) -> HybridResult:
    """Text and vector signals in one ranking: rank, kind, id, score, lexical, semantic, facet.

    ``embed(text, dimension)`` is the hash embedder if none is given.  If it fails, a hybrid
    search goes on with text alone and says so; a semantic one raises.
    """
    words = words.strip()
    if not words:
        raise InvalidArgument("an empty search")
    if mode not in (TEXT, SEMANTIC, HYBRID):
        raise InvalidArgument(f"mode {mode!r}")
    n = max(32, 6 * max(limit, 1))
    spark, warning = graph.spark, None
    empty = "kind tinyint, id bigint, "
    lexical = spark.createDataFrame([], empty + "lexical double")
    semantic = spark.createDataFrame([], empty + "semantic double, facet int")
    if mode != SEMANTIC:
        found = lexical_search(graph, words, n)
        best = F.max("score").over(Window.partitionBy(F.lit(0)))  # over the n candidates only
        lexical = found.select("kind", "id", F.least(F.lit(1.0), F.col("score") / best).alias("lexical"))
    if mode != TEXT:
        try:
            vector = (embed or embedding.hash_embedding)(words, graph.dimension)
        except Exception as e:
            if mode == SEMANTIC:
                raise
            vector, warning = None, f"no semantic signal ({e}); text matches only"
        if vector is not None:
            hits, _ = sketch.vector_search_adaptive(graph, vector, n)
            semantic = hits.select("kind", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 1) / 2)).alias("semantic"), "facet")
    both = lexical.join(semantic, ["kind", "id"], "full")
    lex, sem = F.coalesce("lexical", F.lit(0.0)), F.coalesce("semantic", F.lit(0.0))
    score = {TEXT: lex, SEMANTIC: sem, HYBRID: lex * LEXICAL_SHARE + sem * SEMANTIC_SHARE}[mode]
    ranked = both.withColumn("score", F.round(score, DIGITS)).orderBy(F.desc("score"), "kind", "id").limit(max(limit, 1))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "kind", "id"))
    return HybridResult(ranked.withColumn("rank", rank).select("rank", "kind", "id", "score", "lexical", "semantic", "facet"), warning)


def titled(graph: Graph, hits: DataFrame, target: tuple[int, ...] = BOTH_KINDS) -> DataFrame:
    """Hits, which are of the given kinds, with the label, a title and a detail line of their elements."""
    first = lambda keys: F.coalesce(*[label_text(F.col("props")[k]) for k in keys])
    elements = hits.join(graph.elements_of(target), ["kind", "id"])
    return elements.select(*hits.columns, "label", clipped(F.coalesce(first(TITLE_KEYS), F.concat("label", F.lit(" "), F.col("id").cast("string"))), TITLE_CHARACTERS).alias("title"), clipped(first(DETAIL_KEYS), DETAIL_CHARACTERS).alias("detail"))


# --- snapshots ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """A bounded part of a graph: nodes (id, label, degree), edges (id, source, target, label), read when asked for."""

    nodes: DataFrame
    told_edges: Callable[[], DataFrame]
    sampled: bool

    @cached_property
    def edges(self) -> DataFrame:
        return self.told_edges()


#: Ranges of a column's values that are counted to find places in its order.
RANGES = 1 << 16
#: Rows up to which an order is taken by one bounded heap, and ids up to which a set is broadcast.
HEAP = 1 << 20


def _ranges(frame: DataFrame, column: str) -> tuple[Column, list[tuple[int, int]]]:
    """A column's range number, and the rows of each range in order: narrow counts, no row is moved."""
    low, high = frame.agg(F.min(column), F.max(column)).first()
    if low is None:
        return F.lit(0).cast("bigint"), []
    width = (high - low) // RANGES + 1
    of = F.expr(f"({column} - {low}L) div {width}L")
    return of, sorted(tuple(r) for r in frame.groupBy(of.alias("range")).count().collect())


def _nth(frame: DataFrame, column: str, stride: int, limit: int) -> list:
    """Every ``stride``-th row by ``column``, ``limit`` at most.  Only rows of ranges that have such a place are sorted."""
    if stride <= 1:
        return frame.orderBy(column).limit(limit).collect()
    of, counts = _ranges(frame, column)
    held, total = [], 0
    for r, n in counts:
        first = -(-total // stride) * stride
        if first < total + n and first // stride < limit:
            held.append((r, total))
        total += n
    before = frame.sparkSession.createDataFrame(held, "__range bigint, __before bigint")
    near = frame.withColumn("__range", of).join(F.broadcast(before), "__range")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1
    chosen = near.withColumn("__at", place).where(F.col("__at") % stride == 0).drop("__range", "__before", "__at")
    return chosen.orderBy(column).limit(limit).collect()


def _first(frame: DataFrame, column: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by ``column``; many are told by the ranges that lie before the limit, not by one heap."""
    if limit <= HEAP:
        return frame.orderBy(column).limit(limit)
    of, counts = _ranges(frame, column)
    total = 0
    for r, n in counts:
        if total + n > limit:
            return frame.where(of < r).unionByName(frame.where(of == r).orderBy(column).limit(limit - total))
        total += n
    return frame


def snapshot(graph: Graph, max_nodes: int = 50_000, max_edges: int = 150_000) -> Snapshot:
    """At most so many nodes and edges.  Where nodes are too many, the chosen ones pass the driver, which their number bounds.

    If there are too many nodes, endpoints of edges at an even stride come first, then
    nodes at an even stride; edges are the first ones by id between chosen nodes.  A graph that
    fits whole is not chosen from: ends are counted once, and edges are neither joined nor ordered.
    """
    max_nodes, max_edges, spark = max(1, max_nodes), max(1, max_edges), graph.spark
    n, m = graph.node_count, graph.edge_count
    nodes = graph.nodes
    if n <= max_nodes and m <= max_edges:
        ends = write_table(graph.ends.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")), "degrees")
        if ends.join(nodes.select("id"), "id", "left_anti").isEmpty():
            told = nodes.select("id", "label").join(ends, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
            return Snapshot(told, lambda: graph.edges.select("id", "source", "target", "label"), False)
    bounded = lambda frame: frame
    if n > max_nodes:
        chosen: dict[int, None] = {}
        stride = max(1, -(-m // max_edges))
        for r in _nth(graph.edges.select("id", "source", "target"), "id", stride, max_edges):
            need = {r["source"], r["target"]} - chosen.keys()
            # a new self-loop is weighed as two places, as each end is looked at on its own
            weight = (r["source"] not in chosen) + (r["target"] not in chosen)
            if len(chosen) + weight <= max_nodes:
                chosen.update(dict.fromkeys(need))
            if len(chosen) == max_nodes:
                break
        if len(chosen) < max_nodes:
            stride = max(1, -(-n // (max_nodes - len(chosen))))
            for r in _nth(graph.nodes.select("id"), "id", stride, n):
                chosen[r["id"]] = None
                if len(chosen) == max_nodes:
                    break
        if len(chosen) <= HEAP:
            bounded = F.broadcast
        ids = spark.createDataFrame([(i,) for i in sorted(chosen)], "id bigint")
        nodes = write_table(nodes.select("id", "label").join(bounded(ids), "id", "left_semi"), "nodes")
    inside = graph.edges.select("id", "source", "target", "label").join(bounded(nodes.select(F.col("id").alias("source"))), "source", "left_semi").join(bounded(nodes.select(F.col("id").alias("target"))), "target", "left_semi")
    edges = write_table(_first(inside.select("id", "source", "target", "label"), "id", max_edges) if m > max_edges else inside.select("id", "source", "target", "label"), "edges")
    kept = edges.count()
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    told = nodes.select("id", "label").join(ends, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    return Snapshot(told, lambda: edges, min(n, max_nodes) < n or kept < m)


def including_path(part: Snapshot, graph: Graph, nodes: list[int], edges: list[int]) -> Snapshot:
    """A snapshot and the elements of a path, with degrees counted anew."""
    more_nodes = graph.nodes.where(F.col("id").isin(nodes)).select("id", "label")
    more_edges = graph.edges.where(F.col("id").isin(edges)).select("id", "source", "target", "label")
    all_nodes = part.nodes.select("id", "label").unionByName(more_nodes).distinct()
    all_edges = part.edges.unionByName(more_edges).distinct()
    ends = all_edges.select(F.col("source").alias("id")).unionByName(all_edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return Snapshot(all_nodes.join(ends, "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree")), lambda: all_edges, part.sampled)


@dataclass(frozen=True)
class Focus:
    """Context around a node or edge: layers of node ids, edge ids, and each node's parent."""

    layers: list[list[int]]
    edges: list[int]
    parents: dict[int, int]

    @property
    def nodes(self) -> list[int]:
        return [n for layer in self.layers for n in layer]


def focus(part: Snapshot, node: int | None = None, edge: int | None = None, depth: int = 1, node_budget: int | None = None, edge_budget: int = 64) -> Focus | None:
    """A budgeted neighbourhood that takes turns over frontier nodes and edge labels, low degrees first.

    Works on a snapshot, whose size is bounded, on the driver.
    """
    degree = dict(part.nodes.select("id", "degree").collect())
    rows = part.edges.orderBy("id").collect()
    found = next((r for r in rows if r["id"] == edge), None) if edge is not None else None
    if (node is not None and node not in degree) or (node is None and found is None):
        return None
    roots = [node] if node is not None else [found["source"], found["target"]]
    seen, used = set(roots), {edge} if found is not None else set()
    node_budget = max(edge_budget + 2 if node_budget is None else node_budget, len(roots))
    edge_budget = max(edge_budget, len(used))
    at: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for r in rows:
        if r["source"] != r["target"]:
            at.setdefault(r["source"], {}).setdefault(r["label"], []).append((r["id"], r["target"]))
            at.setdefault(r["target"], {}).setdefault(r["label"], []).append((r["id"], r["source"]))
    layers, parents, total = [roots], {}, len(roots)
    for level in range(1, depth + 1):
        if total >= node_budget or len(used) >= edge_budget:
            break
        left, room = node_budget - total, depth - level + 1
        budget = left if room == 1 else max(1, left // (room + 1))
        # one queue for each frontier node and label, in that order; each turn takes one new node from each
        queues = [(n, iter(sorted(es, key=lambda x: (degree[x[1]], x[1], x[0])))) for n in layers[-1] for _, es in sorted(at.get(n, {}).items())]
        fresh: list[int] = []
        full = lambda: len(fresh) == budget or len(used) == edge_budget
        moved = True
        while moved and not full():
            moved = False
            for parent, queue in queues:
                if full():
                    break
                step = next(((e, x) for e, x in queue if x not in seen), None)
                if step is not None:
                    seen.add(step[1])
                    used.add(step[0])
                    fresh.append(step[1])
                    parents[step[1]] = parent
                    moved = True
        if not fresh:
            break
        total += len(fresh)
        layers.append(fresh)
    for r in rows:  # links between chosen nodes, while the budget lasts
        if len(used) >= edge_budget:
            break
        if r["source"] in seen and r["target"] in seen:
            used.add(r["id"])
    return Focus(layers, sorted(used), parents)


def orbit(part: Snapshot, radius: float = 1.0) -> DataFrame:
    """Nodes on a circle in id order: id, x, y."""
    placed = numbered(part.nodes.select("id"), ["id"], "at")
    n = placed.count()
    angle = F.lit(2.0) * F.pi() * F.col("at") / F.lit(max(1, n))
    return placed.select("id", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))


def is_forest(part: Snapshot) -> bool:
    """Whether a snapshot's edges form no cycle, directions aside."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for r in part.edges.select("source", "target").collect():
        a, b = root(r[0]), root(r[1])
        if a == b:
            return False
        up[a] = b
    return True


def element_degrees(graph: Graph, ids: DataFrame) -> DataFrame:
    """Degrees of some nodes."""
    return steps(graph, BOTH).join(ids.select(F.col("id").alias("node")), "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree"))


def radial_forest(part: Snapshot, gap: float = 1.0) -> DataFrame:
    """Nodes on circles by their depth below the busiest node of each component: id, depth, x, y.

    Trees stand side by side by share of the circle; a node stands in the middle of its
    leaves.  Works on a snapshot, on the driver.
    """
    import math

    degree = dict(part.nodes.select("id", "degree").collect())
    near: dict[int, list[int]] = {n: [] for n in degree}
    for r in part.edges.orderBy("id").select("source", "target").collect():
        if r["source"] != r["target"]:
            near[r["source"]].append(r["target"])
            near[r["target"]].append(r["source"])
    depth: dict[int, int] = {}
    children: dict[int, list[int]] = {}
    order: list[int] = []
    for root in sorted(degree, key=lambda n: (-degree[n], n)):
        if root in depth:
            continue
        depth[root] = 0
        layer = [root]
        while layer:
            order += layer
            following = []
            for n in layer:
                fresh = [m for m in sorted(set(near[n])) if m not in depth]
                children[n] = fresh
                for m in fresh:
                    depth[m] = depth[n] + 1
                following += fresh
            layer = following
    leaves = {}
    for n in reversed(order):
        leaves[n] = sum(leaves[m] for m in children[n]) or 1
    total, at, start = max(1, sum(leaves[n] for n in order if depth[n] == 0)), 0, {}
    for n in order:
        if depth[n] == 0:
            start[n] = at
            at += leaves[n]
        inner = start[n]
        for m in children[n]:
            start[m] = inner
            inner += leaves[m]
    alone = sum(1 for n in order if depth[n] == 0) == 1
    rows = []
    for n in order:
        angle, radius = 2 * math.pi * (start[n] + leaves[n] / 2) / total, gap * (depth[n] + (0 if alone else 1))
        rows.append((n, depth[n], radius * math.cos(angle), radius * math.sin(angle)))
    return part.nodes.sparkSession.createDataFrame(rows, "id bigint, depth int, x double, y double")
