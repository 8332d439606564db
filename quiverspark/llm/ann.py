"""Nearest neighbours by stable projections, a kd-tree over them and a chi-square stopping test.

A Gaussian projection keeps distances in distribution: the squared projected distance
over the squared true one is chi-square with as many degrees as there are projected
dimensions.  So neighbours are taken in the order of their projected distance and
verified on the full vectors until that test says, with the asked confidence, that none
of the rest can be nearer than the k-th found so far.

How many projections are worth their cost is measured on the sample (``chosen``): more of
them cost more a row and let the test stop earlier.  A true neighbour passes the test with
at least the asked confidence, whatever their number, so the confidence bounds the recall.

Equal vectors are one class that carries its k+1 smallest ids (more can never be asked
for), so a vector that a third of the rows share is searched once.  The tree is fitted on
a bounded sample and has a bounded number of leaves; every class is put into its leaf, and
leaves into blocks of at most about 2048 classes by a hash.  A first pass searches one
block of each query's own leaf for a bound, a second visits the leaves that the bound and
the test leave open.  Each block meets its queries in one task, in portions of some
megabytes of queries; a block is copied for its own visitors' portions alone, and one that
nobody visits is not moved.  Vectors of different lengths are no neighbours: each of the
most frequent lengths has its tree, any other one is a single leaf.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverspark.llm import common
from quiverspark.plans.workspace import partitions_for, write_table


@dataclass(frozen=True)
class Options:
    """Neighbours, projection, confidence of the stopping test, and bounds."""

    k: int = 10
    projected: int | None = None  # even, for the closed form of the distribution; measured if None
    confidence: float = 0.96
    sample: int = 20_000  # classes for fitting the tree, and for choosing the projections
    sample_numbers: int = 1 << 22  # components of that sample, which the driver holds: fewer classes of long vectors
    trees: int = 16  # lengths of vectors with a tree of their own
    leaf: int = 1024
    leaves: int = 1 << 14
    block: int = 2048
    numbers_at_once: int = 1 << 20  # components of the queries that meet a block in one task
    step: int = 32
    seed: int = 3

    def queries_at_once(self, d: int) -> int:
        return max(64, self.numbers_at_once // d)

    def sampled(self, d: int) -> int:
        return min(self.sample, max(64, self.sample_numbers // d))


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees."""
    term, total = 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, degrees) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < p else (low, middle)
    return high


PROJECTED = (8, 16, 24, 32)
GATHERED = 6  # what verifying a component costs, in units of a projected one


def projection_of(d: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, m))


def chosen(sample: np.ndarray, options: Options) -> int:
    """The number of projections that costs least on the sample: each row of a block is projected, and the
    share that the test leaves open is verified on whole vectors."""
    asked = sample[:: max(1, len(sample) // 100)][:100]
    true = np.maximum((asked * asked).sum(axis=1)[:, None] + (sample * sample).sum(axis=1)[None] - 2 * asked @ sample.T, 0)
    if len(sample) <= options.k + 1:
        return PROJECTED[0]
    kth = np.partition(true, options.k, axis=1)[:, options.k]
    cost = {}
    for m in PROJECTED:
        projection = projection_of(sample.shape[1], m, options.seed)
        p, q = sample @ projection, asked @ projection
        near = (q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * q @ p.T
        cost[m] = m + GATHERED * sample.shape[1] * float((near <= chi_square_quantile(options.confidence, m) * kth[:, None]).mean())
    return min(cost, key=cost.get)


@dataclass
class Tree:
    """Splits of the projected space; leaves are numbered from 0 and known by their boxes."""

    projection: np.ndarray
    axis: np.ndarray  # -1 at a leaf
    split: np.ndarray
    left: np.ndarray  # the leaf's number at a leaf
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, options: Options) -> Tree:
        m = options.projected or chosen(sample, options)
        projection = projection_of(sample.shape[1], m, options.seed)
        points = sample @ projection
        wanted = min(options.leaves, max(1, math.ceil(rows / options.leaf)))
        axis, split, left, low, high = [], [], [], [], []
        todo = [(points, np.full(m, -np.inf), np.full(m, np.inf), wanted)]
        at = 0
        while at < len(todo):
            part, a, b, share = todo[at]
            todo[at] = None
            at += 1
            width = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(m)
            k = int(width.argmax())
            if share < 2 or len(part) < 4 or width[k] <= 0:
                axis.append(-1)
                split.append(0.0)
                left.append(len(low))
                low.append(a)
                high.append(b)
                continue
            value = float(np.median(part[:, k]))
            below = part[:, k] < value
            if not below.any():
                value = float(part[:, k][part[:, k] > value].min())
                below = part[:, k] < value
            under, over = b.copy(), a.copy()
            under[k], over[k] = value, value
            axis.append(k)
            split.append(value)
            left.append(len(todo))
            todo += [(part[below], a, under, share // 2), (part[~below], over, b, share - share // 2)]
        return cls(projection, np.array(axis), np.array(split), np.array(left), np.array(low), np.array(high))

    @classmethod
    def single(cls, d: int, options: Options) -> Tree:
        """One leaf, which is always open."""
        m = options.projected or PROJECTED[0]
        return cls(projection_of(d, m, options.seed), np.array([-1]), np.zeros(1), np.zeros(1, dtype=np.int64), np.full((1, m), -np.inf), np.full((1, m), np.inf))

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        points, node = vectors @ self.projection, np.zeros(len(vectors), dtype=np.int64)
        while len(going := np.flatnonzero(self.axis[node] >= 0)):
            here = node[going]
            node[going] = self.left[here] + (points[going, self.axis[here]] >= self.split[here])
        return self.left[node]

    def open_leaves(self, vectors: np.ndarray, radius2: np.ndarray) -> list[np.ndarray]:
        """For each vector the leaves whose boxes come within the radius."""
        points = vectors @ self.projection
        found = []
        for p, r in zip(points, radius2, strict=True):
            away = np.maximum(np.maximum(self.low - p, p - self.high), 0)
            found.append(np.flatnonzero((away * away).sum(axis=1) <= r))
        return found


def usable(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, vector) of rows that take part: no null, zero, or non-finite vector."""
    numbers = F.col(column).cast("array<double>")
    fine = F.col(id_column).isNotNull() & F.col(column).isNotNull() & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(numbers, lambda x: x != 0)
    return rows.where(fine).select(F.col(id_column).cast("long").alias("id"), F.transform(numbers, lambda x: x + F.lit(0.0)).alias("vector"))


@dataclass
class Trees:
    """A tree for each of the frequent lengths of vectors; one leaf for any other length."""

    known: dict[int, Tree]
    options: Options

    def of(self, d: int) -> Tree:
        if d not in self.known:
            self.known[d] = Tree.single(d, self.options)
        return self.known[d]

    def limit(self, d: int) -> float:
        return chi_square_quantile(self.options.confidence, self.of(d).projection.shape[1])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of one batch, by length."""
    lengths = batch["vector"].value_lengths().to_numpy()
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        part = batch["vector"].take(pa.array(rows))
        yield int(d), rows, part.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


NEAR = "query long, id long, distance double"


def visit_block(x: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, names: np.ndarray, bounds: np.ndarray, tree: Tree, options: Options) -> tuple[pd.DataFrame, int]:
    """The k+1 nearest ids of one block for each of its queries, those of a query's own class included, and
    how many pairs were verified.  Only the steps that the stopping test opens are compared on whole vectors."""
    keep, limit = options.k + 1, chi_square_quantile(options.confidence, tree.projection.shape[1])
    copies = np.array([len(i) for i in ids])
    px, xx = x @ tree.projection, (x * x).sum(axis=1)
    pxx = (px * px).sum(axis=1)
    out_q, out_i, out_d, verified = [], [], [], 0
    at_once = max(1, (1 << 21) // (options.step * x.shape[1]))
    for at in range(0, len(queries), at_once):
        q, bound2 = queries[at : at + at_once], bounds[at : at + at_once] ** 2
        pq, qq = q @ tree.projection, (q * q).sum(axis=1)
        near = (pq * pq).sum(axis=1)[:, None] + pxx[None] - 2 * pq @ px.T
        order = np.argsort(near, axis=1)
        near = np.take_along_axis(near, order, axis=1)
        best = np.repeat(bound2[:, None], keep, axis=1)
        true = np.full(near.shape, np.inf)
        seen = np.zeros(len(q), dtype=np.int64)
        going = np.ones(len(q), dtype=bool)
        for s in range(0, near.shape[1], options.step):
            going &= near[:, s] <= limit * best.max(axis=1) * (1 + 1e-9) + 1e-12
            a = np.flatnonzero(going)
            if not len(a):
                break
            c = order[a, s : s + options.step]
            more = np.maximum(qq[a][:, None] + xx[c] - 2 * np.einsum("qsd,qd->qs", x[c], q[a]), 0)
            true[a, s : s + options.step] = more
            best[a] = np.partition(np.concatenate((best[a], more), axis=1), keep - 1, axis=1)[:, :keep]
            seen[a] = s + c.shape[1]
            verified += c.size
        for r in range(len(q)):
            c, d2 = order[r, : seen[r]], true[r, : seen[r]]
            if not len(c):
                continue
            if len(c) > 4 * keep:
                cut = np.partition(d2, 2 * keep)[2 * keep] * (1 + 1e-9)
                c, d2 = c[d2 <= cut], d2[d2 <= cut]
            difference = x[c] - q[r]
            exact = np.sqrt((difference * difference).sum(axis=1))
            spread = np.repeat(exact, copies[c])
            own = np.concatenate([ids[i] for i in c])
            first = np.lexsort((own, spread))[:keep]
            out_q.append(np.full(len(first), names[at + r]))
            out_i.append(own[first])
            out_d.append(spread[first])
    none = [np.zeros(0, dtype=np.int64)]
    return pd.DataFrame({"query": np.concatenate(out_q or none), "id": np.concatenate(out_i or none), "distance": np.concatenate(out_d or [np.zeros(0)])}), verified


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, trees: Trees, options: Options) -> pd.DataFrame:
    """``visit_block`` for the rows and queries of one key."""
    x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    q = np.stack(queries["vector"].to_numpy()).astype(np.float64)
    ids = [np.asarray(i, dtype=np.int64) for i in rows["ids"]]
    return visit_block(x, ids, q, queries["query"].to_numpy(), queries["bound"].to_numpy(dtype=np.float64), trees.of(x.shape[1]), options)[0]


def sample_of(classes: DataFrame, d: int, n: int, options: Options) -> np.ndarray:
    """The classes of length ``d`` with the smallest hashes, of ``n`` in all, as a matrix.

    Each task of an ordered limit sends the driver that many rows, so hashes that cannot be
    among the smallest are left out first: some hundred rows too many pass, whatever the
    number of tasks.
    """
    wanted = options.sampled(d)
    rows = classes.where(F.col("d") == d)
    passing = wanted + 8 * math.isqrt(wanted) + 32
    if passing < n:
        rows = rows.where(F.col("class") < -(1 << 63) + (passing << 64) // n)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch["class"], pa.array([v.tobytes() for v in x], type=pa.binary())], names=["class", "vector"])

    found = rows.select("class", "vector").mapInArrow(packed, "class long, vector binary").orderBy("class").limit(wanted).collect()
    return np.frombuffer(b"".join(r["vector"] for r in found), dtype=np.float64).reshape(-1, d)


SALTS = 16


def nearest(rows: DataFrame, is_query, options: Options = Options(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest rows.

    ``is_query`` is a condition on the column ``id``.  Candidates are all other rows with a
    vector of the query's length; equal distances go to smaller ids.  Null ids, and vectors
    that are null, empty, zero or hold a null or non-finite number, take no part.  Rows
    that share an id are separate candidates, and one query if their vectors agree.  Fewer
    candidates than k are all returned; an empty table gives no rows; extra columns are not read.
    """
    spark = rows.sparkSession
    found = usable(rows, id_column, column)
    smallest = Window.partitionBy("vector").orderBy("id")
    few = found.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= options.k + 1)
    classes = write_table(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("class", F.xxhash64("vector")).withColumn("d", F.size("vector")), "classes")
    lengths = classes.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(options.trees).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = {}
    for d, n in lengths:
        known[d] = Tree.fit(sample_of(classes, d, n, options), n, options)
    shared, version = spark.sparkContext.broadcast(Trees(known, options)), uuid.uuid4().hex

    def with_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(batch.num_rows, dtype=np.int32)
            for d, at, x in _by_length(batch):
                leaf[at] = shared.value.of(d).leaf_of(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    home = ["d", "leaf"]
    placed = write_table(classes.mapInArrow(with_leaf, "vector array<double>, ids array<long>, class long, d int, leaf int"), "placed")
    sizes = placed.groupBy(*home).agg(F.ceil(F.count("*") / options.block).cast("int").alias("blocks"))  # a row a leaf
    sizes = F.broadcast(write_table(sizes, "sizes"))  # vectors must not be what a join broadcasts
    blocked = placed.join(sizes, home).select(*home, F.pmod("class", "blocks").cast("int").alias("block"), "ids", "vector")
    asked = found.where(is_query).select("id", "vector").distinct()
    queries = write_table(asked.groupBy("vector").agg(F.min("id").alias("query")).withColumn("class", F.xxhash64("vector")).withColumn("d", F.size("vector")), "queries")
    tasks = partitions_for(rows)
    at_once = F.greatest(F.lit(64), F.floor(F.lit(options.numbers_at_once) / F.col("d")))
    place = [*home, "block", "portion"]

    def block_of(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": pd.Series(dtype=np.int64), "id": pd.Series(dtype=np.int64), "distance": pd.Series(dtype=np.float64)})
        return search_block(left, right, common.per_process("kd-tree", version, lambda: shared.value), options)

    def searched(visits: DataFrame) -> DataFrame:
        """Results of visits (d, leaf, block, query, vector, bound): visitors are dealt into portions, and
        each block goes to the portions of its own visitors."""
        visits = write_table(visits, "visits")
        portions = visits.groupBy(*home, "block").agg(F.ceil(F.count("*") / at_once).cast("int").alias("portions"))  # a row a block
        portions = F.broadcast(write_table(portions, "portions"))
        right = visits.join(portions, [*home, "block"]).withColumn("portion", F.pmod(F.xxhash64("query"), "portions").cast("int")).drop("portions")
        left = blocked.join(portions, [*home, "block"]).withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).drop("portions")
        return left.repartition(tasks, *place).groupBy(*place).cogroup(right.repartition(tasks, *place).groupBy(*place)).applyInPandas(block_of, NEAR)

    # first pass: one block of the query's own leaf gives a bound
    at_home = queries.mapInArrow(with_leaf, "vector array<double>, query long, class long, d int, leaf int").join(sizes, home)
    first = at_home.select(*home, F.pmod("class", "blocks").cast("int").alias("block"), "query", "vector", F.lit(float("inf")).alias("bound"))
    kth = searched(first).groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    bounded = write_table(queries.join(kth, "query", "left").select("query", "vector", "d", F.when(F.col("n") > options.k, F.col("far")).otherwise(float("inf")).alias("bound")), "bounded")

    # second pass: every leaf that the bound and the test leave open
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.narrow_batches(batches, 64):
            bound = batch["bound"].to_numpy()
            for d, at, x in _by_length(batch):
                leaves = shared.value.of(d).open_leaves(x, shared.value.limit(d) * bound[at] ** 2 * (1 + 1e-9) + 1e-12)
                again = pa.array(np.repeat(at, [len(o) for o in leaves]))
                yield pa.RecordBatch.from_arrays([*[c.take(again) for c in batch.columns], pa.array(np.concatenate(leaves).astype(np.int32))], names=[*batch.schema.names, "leaf"])

    opened = bounded.mapInArrow(visit, "query long, vector array<double>, d int, bound double, leaf int").join(sizes, home)
    second = opened.select(*home, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", "vector", "bound")
    best = Window.partitionBy("query").orderBy("distance", "id")
    merged = searched(second).withColumn("n", F.row_number().over(best)).where(F.col("n") <= options.k + 1)
    # give the class's result to each of its queries, without the query itself; a vector that many queries
    # share is dealt over some tasks, to each of which its one result goes
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    owners = asked.select("id", "vector", salt).join(queries.select("vector", "query", every).hint("merge"), ["vector", "salt"]).select(F.col("id").alias("query_id"), "query", "salt")
    others = merged.select("query", "id", "distance", every).join(owners, ["query", "salt"]).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id", "query"))
    return others.withColumn("rank", rank).where(F.col("rank") <= options.k).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
