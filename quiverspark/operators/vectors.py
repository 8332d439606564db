"""Exact vector search and weighted late interaction.

Scores are dot products of 64-bit accumulations, compared at nine decimals so that equal
vectors tie whatever the order of summation.  An element's score is that of its best facet
(the lowest one among equals).  The k kept are the greatest by (score, kind, id); they are
given out by score, then smallest element first.

Many queries are answered in one job: each task multiplies its vectors with all query
vectors and keeps k elements a query, so what is shuffled is k rows a query and task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverspark.graph import COSINE, Graph
from quiverspark.model import BOTH_KINDS, InvalidArgument
from quiverspark.plans.workspace import write_observed, write_table

DIGITS = 9
#: Vectors and scores that a task holds at once, and elements that it keeps for all queries of a pass.
ROWS, SCORES, KEPT = 1 << 13, 1 << 22, 1 << 22
HITS_DDL = "query int, kind tinyint, id bigint, facet int, score double"
_HITS = pa.schema([("query", pa.int32()), ("kind", pa.int8()), ("id", pa.int64()), ("facet", pa.int32()), ("score", pa.float64())])


def prepared_query(graph: Graph, query: Sequence[float]) -> np.ndarray:
    """The query as doubles, normalised under cosine; raises for wrong length, non-finite or zero."""
    q = np.asarray(query, dtype=np.float64)
    if q.shape != (graph.dimension,):
        raise InvalidArgument(f"a query of {q.size} components for vectors of {graph.dimension}")
    if not np.isfinite(q).all():
        raise InvalidArgument("a query component is not finite")
    if graph.similarity == COSINE:
        norm = math.sqrt(float((q * q).sum()))
        if norm == 0:
            raise InvalidArgument("a zero query has no direction")
        if abs(norm - 1) > 1e-6:
            q = q / norm
    return q


def normalised(vectors: DataFrame, similarity: str = COSINE) -> DataFrame:
    """``vectors`` with ``vec`` of length one under cosine; vectors that have it to six decimals stay as they are."""
    if similarity != COSINE:
        return vectors
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = F.transform("vec", lambda x: (x.cast("double") / F.col("norm")).cast("float"))
    return vectors.withColumn("norm", norm).withColumn("vec", F.when(F.abs(F.col("norm") - 1) > 1e-6, scaled).otherwise(F.col("vec"))).drop("norm")


def _best_elements(kind: np.ndarray, ident: np.ndarray, facet: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """Elements of a batch with, for every query, their best score and its facet."""
    order = np.lexsort((facet, ident, kind))
    kind, ident, facet, scores = kind[order], ident[order], facet[order], scores[:, order]
    first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (ident[1:] != ident[:-1])])
    best = np.maximum.reduceat(scores, first, axis=1)
    sizes = np.diff(np.append(first, len(kind)))
    if (sizes == 1).all():
        return kind, ident, np.broadcast_to(facet, scores.shape), scores
    where = np.where(scores == np.repeat(best, sizes, axis=1), facet, np.iinfo(np.int32).max)
    return kind[first], ident[first], np.minimum.reduceat(where, first, axis=1), best


def _columns(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, ...]:
    x = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
    return batch["kind"].to_numpy(), batch["id"].to_numpy(), batch["facet"].to_numpy(), x


def _top(query: np.ndarray, kind: np.ndarray, ident: np.ndarray, facet: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k greatest elements of every query by (score, kind, id), an element once."""
    rows = (query, kind, ident, facet, score)
    order = np.lexsort((facet, -score, ident, kind, query))
    query, kind, ident, facet, score = (c[order] for c in rows)
    new = np.r_[True, (query[1:] != query[:-1]) | (kind[1:] != kind[:-1]) | (ident[1:] != ident[:-1])]
    rows = tuple(c[new] for c in (query, kind, ident, facet, score))
    order = np.lexsort((-rows[2], -rows[1].astype(np.int64), -rows[4], rows[0]))
    query = rows[0][order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return tuple(c[order][place < k] for c in rows)


def scored(vectors: DataFrame, queries: np.ndarray, k: int, first: int = 0) -> DataFrame:
    """Per task and query the k greatest elements: query, kind, id, facet, score; queries are numbered from ``first``.

    Queries are taken in blocks, so the scores that a task holds do not grow with them.  A vector
    below the k-th score of what a query has so far is passed over before anything is sorted.
    """
    block = max(1, SCORES // ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, ...]] = {}
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                kind, ident, facet, x = _columns(batch.slice(at, ROWS), queries.shape[1])
                for q in range(0, len(queries), block):
                    found = _candidates(kind, ident, facet, queries[q : q + block] @ x.T, k, floors.get(q))
                    if not len(found[0]):
                        continue
                    if q in kept:
                        found = tuple(np.concatenate(pair) for pair in zip(kept[q], found, strict=True))
                    kept[q] = _top(*found, k)
                    n = len(queries[q : q + block])
                    if (np.bincount(kept[q][0], minlength=n) == k).all():
                        floors[q] = np.full(n, np.inf)
                        np.minimum.at(floors[q], kept[q][0], kept[q][4])
        for q, (query, *rest) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((query + np.int32(first + q), *rest), _HITS, strict=True)], schema=_HITS)

    return vectors.select("kind", "id", "facet", "vec").mapInArrow(run, HITS_DDL)


def _candidates(kind: np.ndarray, ident: np.ndarray, facet: np.ndarray, scores: np.ndarray, k: int, floor: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """What may be among the k greatest of each query: query, kind, id, facet, score."""
    if floor is not None:  # full lists: facets that reach their last score, of which the best is told when they are merged
        q, at = np.nonzero(scores >= (floor - 1e-8 - 1e-12 * np.abs(floor))[:, None])
        return q.astype(np.int32), kind[at], ident[at], facet[at], np.round(scores[q, at], DIGITS)
    kind, ident, facet, best = _best_elements(kind, ident, facet, np.round(scores, DIGITS))
    bar = np.full(len(best), -np.inf) if best.shape[1] <= k else np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
    q, at = np.nonzero(best >= bar[:, None])
    return q.astype(np.int32), kind[at], ident[at], np.broadcast_to(facet, best.shape)[q, at], best[q, at]


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The k of every query in the order in which hits are given out, with their rank from 1."""
    element = hits.groupBy("query", "kind", "id").agg(F.max(F.struct("score", (-F.col("facet")).alias("back"))).alias("top"))
    flat = element.select("query", "kind", "id", (-F.col("top.back")).alias("facet"), F.col("top.score").alias("score"))
    keep = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("kind"), F.desc("id"))
    show = Window.partitionBy("query").orderBy(F.desc("score"), "kind", "id")
    return flat.withColumn("n", F.row_number().over(keep)).where(F.col("n") <= k).drop("n").withColumn("rank", F.row_number().over(show))


def candidates(graph: Graph, target: tuple[int, ...] = BOTH_KINDS, label: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """The vectors that a search may see: filtered before anything is scored."""
    return graph.vectors_of(target, label) if within is None else among(graph.vectors_of, within, target, label)


#: Elements of a set up to which it is broadcast: two numbers each.
BROADCAST_ELEMENTS = 1 << 20


def among(read: Callable[[tuple[int, ...]], DataFrame], within: DataFrame, target: tuple[int, ...], label: str | None) -> DataFrame:
    """Rows of a set's elements.  The set is written once; vectors of a kind that it lacks are not read, and none are
    shuffled unless the set is too large for every task to hold."""
    few, seen = write_observed(within.select("kind", "id"), "within", n=F.count(F.lit(1)), kinds=F.bit_or(F.expr("shiftleft(1, CAST(kind AS INT))")))
    held = tuple(k for k in target if (seen["kinds"] or 0) >> k & 1)
    found = read(held or target[:1])
    found = found if label is None else found.where(F.col("label") == label)
    return found.join(F.broadcast(few) if seen["n"] <= BROADCAST_ELEMENTS else few, ["kind", "id"], "left_semi")


def vector_search_many(graph: Graph, queries: Sequence[Sequence[float]], k: int, target: tuple[int, ...] = BOTH_KINDS, label: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """Exact search for several queries at once: query, rank, kind, id, facet, score."""
    if k < 0:
        raise InvalidArgument("k can't be negative")
    prepared = np.stack([prepared_query(graph, q) for q in queries])
    found, each, hits = candidates(graph, target, label, within), max(1, KEPT // max(k, 1)), None
    if len(prepared) > each:
        found = write_table(found, "candidates")
    for at in range(0, len(prepared), each):
        part = scored(found, prepared[at : at + each], max(k, 1), at)
        hits = part if hits is None else hits.unionByName(part)
    return best_of(hits, k)


def vector_search(graph: Graph, query: Sequence[float], k: int, target: tuple[int, ...] = BOTH_KINDS, label: str | None = None) -> DataFrame:
    """Exact search: rank, kind, id, facet, score."""
    return vector_search_many(graph, [query], k, target, label).drop("query").orderBy("rank")


def vector_search_within(graph: Graph, query: Sequence[float], within: DataFrame, k: int) -> DataFrame:
    """Exact search inside a set; ids that are not there, or have no vector, are ignored."""
    return vector_search_many(graph, [query], k, within=within).drop("query").orderBy("rank")


# --- late interaction --------------------------------------------------------------------


def checked_weights(queries: Sequence, weights: Sequence[float] | None) -> np.ndarray:
    """Weights that sum to one; equal ones where none are given."""
    if not len(queries):
        raise InvalidArgument("late interaction needs a query vector")
    if weights is None:
        return np.full(len(queries), 1 / len(queries))
    w = np.asarray(weights, dtype=np.float64)
    if len(w) != len(queries):
        raise InvalidArgument("one weight for each query vector")
    if not np.isfinite(w).all() or (w < 0).any():
        raise InvalidArgument("weights must be finite and not negative")
    if w.sum() <= 0:
        raise InvalidArgument("a weight must be positive")
    return w / w.sum()


def best_facets(vectors: DataFrame, queries: np.ndarray) -> DataFrame:
    """For every element one struct (score, minus facet) a query, reduced in the tasks before the shuffle."""
    n = len(queries)
    schema = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("scores", pa.list_(pa.float64())), ("facets", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kind, ident, facet, x = _columns(batch, queries.shape[1])
                kind, ident, facet, best = _best_elements(kind, ident, facet, np.round(queries @ x.T, DIGITS))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(ident), pa.array(list(best.T), type=schema.field(2).type), pa.array(list(np.asarray(facet).T), type=schema.field(3).type)], schema=schema)

    parts = vectors.select("kind", "id", "facet", "vec").mapInArrow(run, "kind tinyint, id bigint, scores array<double>, facets array<int>")
    tops = [F.max(F.struct(F.col("scores")[i].alias("score"), (-F.col("facets")[i]).alias("back"))).alias(f"q{i}") for i in range(n)]
    return parts.groupBy("kind", "id").agg(*tops)


def late_interaction_search(graph: Graph, queries: Sequence[Sequence[float]], k: int, weights: Sequence[float] | None = None, target: tuple[int, ...] = BOTH_KINDS, label: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """Weighted MaxSim: rank, kind, id, score and the best facet for each query vector."""
    w = checked_weights(queries, weights)
    prepared = np.stack([prepared_query(graph, q) for q in queries])
    tops = best_facets(candidates(graph, target, label, within), prepared)
    score = F.lit(0.0)
    for i, share in enumerate(w):
        score = score + F.col(f"q{i}.score") * F.lit(float(share))
    facets = F.array(*[-F.col(f"q{i}.back") for i in range(len(w))]).alias("facets")
    scores = tops.select("kind", "id", F.round(score, DIGITS).alias("score"), facets)
    kept = scores.orderBy(F.desc("score"), F.desc("kind"), F.desc("id")).limit(k)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "kind", "id"))
    return kept.withColumn("rank", rank)


def recall(found: DataFrame, truth: DataFrame, k: int) -> float:
    """Share of the true k elements of every query that were found."""
    keys = ["query", "kind", "id"]
    wanted = truth.where(F.col("rank") <= k).select(*keys)
    total = wanted.count()
    return wanted.join(found.where(F.col("rank") <= k).select(*keys), keys, "left_semi").count() / total if total else 1.0


def recall_against_ids(found: DataFrame, truth: DataFrame, k: int) -> float:
    """Share of official neighbours (query, id) among the first k found, counted over k a query."""
    wanted = truth.select("query", "id").distinct()
    queries = wanted.select("query").distinct().count()
    hits = found.where(F.col("rank") <= k).select("query", "id").join(wanted, ["query", "id"], "left_semi").count()
    return hits / (k * queries) if queries else 1.0
