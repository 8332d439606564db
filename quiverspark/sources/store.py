"""Stored graphs: an immutable base in Parquet, a log of transactions, and their fold.

Layout of a graph's folder::

    meta/                one row: dimension, similarity, last transaction in the base, buckets
    base/nodes, base/edges, base/vectors, base/sketch, base/adjacency, base/props
    log/txn=N/           the changes of one transaction, written once and never changed

A transaction is visible when its folder's commit marker is there, which Spark writes last;
a folder without one is a torn write and is ignored.  The adjacency is bucketed and sorted
by node, so a frontier join shuffles the frontier only; properties are also stored flat, in
ranges of key and value, so a predicate reads few row groups.  One writer at a time is assumed: a
second one that takes the same transaction number fails, as folders are never overwritten.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverspark import model
from quiverspark.graph import COSINE, DOT, Graph, adjacency_of, props_of
from quiverspark.model import EDGE, NODE, PROPS_DDL, Conflict, Corrupt, InvalidArgument, NotFound
from quiverspark.operators import sketch, vectors
from quiverspark.plans.workspace import partitions_for, plan_bytes

META_DDL = "dimension int, similarity string, transactions bigint, buckets int"
LOG_DDL = f"txn bigint, op_order tinyint, op string, kind tinyint, id bigint, source bigint, target bigint, label string, props {PROPS_DDL}, vecs array<array<float>>"
PUT, DELETE = "put", "delete"
#: Order within a transaction: nodes, edges, deleted edges, deleted nodes.
ORDER = {(PUT, NODE): 0, (PUT, EDGE): 1, (DELETE, EDGE): 2, (DELETE, NODE): 3}
#: Bytes of a log up to which the elements it touches are broadcast; they are fewer bytes than their records.
BROADCAST_BYTES = 64 << 20


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _check_new(spark: SparkSession, path: str, dimension: int, similarity: str) -> None:
    if dimension <= 0:
        raise InvalidArgument("a dimension must be positive")
    if similarity not in (COSINE, DOT):
        raise InvalidArgument(f"similarity {similarity!r}")
    if exists(spark, path):
        raise InvalidArgument(f"{path} exists already")


#: Vectors a file: however well they pack, a task that is given whole files then holds a bounded number of them.
VECTORS_A_FILE = 1 << 16
#: Rows of the adjacency a bucket, and of the flat properties a range: so many are sorted in memory.
ROWS_A_BUCKET = 1 << 20


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def write_adjacency(spark: SparkSession, path: str, edges: DataFrame, n: int, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Both directions of the ``n`` edges, bucketed and sorted by node, and the number of buckets."""
    buckets = buckets or max(partitions_for(edges), -(-2 * n // ROWS_A_BUCKET))
    table = f"quiverspark_{uuid.uuid4().hex}"
    adjacency_of(edges).repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: the files stay
    return _bucketed(spark, path, buckets), buckets


def bulk_load(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, vecs: DataFrame, dimension: int, similarity: str = COSINE, buckets: int | None = None, transactions: int = 0) -> None:
    """Write frames as a graph's base; what is left of a failed load is removed.

    The adjacency gets as many buckets as the stored edges have bytes for, unless a number is given.
    """
    _check_new(spark, path, dimension, similarity)
    try:
        nodes.select("id", "label", "props", "generation").write.parquet(f"{path}/base/nodes")
        edges.select("id", "source", "target", "label", "props", "generation").write.parquet(f"{path}/base/edges")
        stored_edges = spark.read.schema(model.EDGES_DDL).parquet(f"{path}/base/edges")
        elements = Graph(spark.read.schema(model.NODES_DDL).parquet(f"{path}/base/nodes"), stored_edges, vecs, dimension).elements
        order = ["key", "tag", "f", "i", "s"]
        n_edges = stored_edges.count()
        ranges = max(partitions_for(elements), -(-n_edges // ROWS_A_BUCKET))
        props_of(elements).repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.parquet(f"{path}/base/props")
        _, buckets = write_adjacency(spark, f"{path}/base/adjacency", stored_edges, n_edges, buckets)
        vectors.normalised(vecs, similarity).select("kind", "id", "facet", "label", "vec").write.option("maxRecordsPerFile", VECTORS_A_FILE).parquet(f"{path}/base/vectors")
        stored = spark.read.schema(model.VECTORS_DDL).parquet(f"{path}/base/vectors")
        sketch.sketch_of(stored, dimension).write.parquet(f"{path}/base/sketch")
        spark.createDataFrame([(dimension, similarity, transactions, buckets)], META_DDL).write.parquet(f"{path}/meta")
    except Exception:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
        raise


def create(spark: SparkSession, path: str, dimension: int, similarity: str = COSINE) -> Store:
    """A new empty graph; refuses a path that exists."""
    empty = lambda ddl: spark.createDataFrame([], ddl)
    bulk_load(spark, path, empty(model.NODES_DDL), empty(model.EDGES_DDL), empty(model.VECTORS_DDL), dimension, similarity, buckets=1)
    return open_graph(spark, path)


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The stored adjacency, known to Spark as bucketed by node."""
    table = f"quiverspark_adjacency_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({model.ADJACENCY_DDL}) USING parquet CLUSTERED BY (node) SORTED BY (node) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the transactions whose folders are complete."""
    if not exists(spark, f"{path}/log"):
        return []
    fs, p = _fs(spark, f"{path}/log")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removeprefix("txn=")) for n in names if n.startswith("txn=") and exists(spark, f"{path}/log/{n}/_SUCCESS"))


def fold(base: Graph, log: DataFrame) -> Graph:
    """Base and log as one graph: the latest record of an element wins, a deleted one is gone.

    Only elements that the log touches are worked on; the rest of the base passes by an
    anti-join.  An element's generation counts its puts since it was (last) created.  The
    stored adjacency stays: edges that the log touches are taken out of it in place, and the
    log's own links, dealt into the same buckets, are put beside it.
    """
    touched = log.select("kind", "id").distinct()
    if plan_bytes(log) <= BROADCAST_BYTES:
        touched = F.broadcast(touched)
    latest = Window.partitionBy("kind", "id").orderBy(F.desc("txn"), F.desc("op_order"))
    every = Window.partitionBy("kind", "id")
    deleted_at = F.max(F.when(F.col("op") == DELETE, F.col("txn"))).over(every)
    since = F.count_if((F.col("op") == PUT) & (F.col("txn") > F.coalesce(deleted_at, F.lit(-1)))).over(every)
    folded = log.withColumn("puts", since).withColumn("was_deleted", deleted_at.isNotNull()).withColumn("n", F.row_number().over(latest)).where("n = 1").where(F.col("op") == PUT)

    def of(kind: int, frame: DataFrame, columns: list[str]) -> DataFrame:
        mine = touched.where(F.col("kind") == kind).select("id")
        kept = frame.join(mine, "id", "left_anti")
        before = frame.join(mine, "id", "left_semi").select("id", F.col("generation").alias("old"))
        fresh = folded.where(F.col("kind") == kind).join(before, "id", "left").withColumn("generation", F.col("puts") + F.when(F.col("was_deleted"), 0).otherwise(F.coalesce("old", F.lit(0))))
        return kept.select(*columns).unionByName(fresh.select(*columns))

    nodes = of(NODE, base.nodes, ["id", "label", "props", "generation"])
    edges = of(EDGE, base.edges, ["id", "source", "target", "label", "props", "generation"])
    logged = folded.select("kind", "id", "label", F.posexplode("vecs").alias("facet", "vec")).select("kind", "id", "facet", "label", "vec")
    kept = base.vectors.join(touched, ["kind", "id"], "left_anti")
    fresh_vectors = vectors.normalised(logged, base.similarity)
    sketches = base.sketch.join(touched, ["kind", "id"], "left_anti").unionByName(sketch.sketch_of(fresh_vectors, base.dimension))
    logged_elements = folded.select("kind", "id", "label", "props")
    props = base.props.join(touched, ["kind", "id"], "left_anti").unionByName(props_of(logged_elements))
    touched_edges = touched.where(F.col("kind") == EDGE).select(F.col("id").alias("edge"))
    links = adjacency_of(folded.where(F.col("kind") == EDGE).select("id", "source", "target", "label"))
    adjacency = base.adjacency.join(touched_edges, "edge", "left_anti").select(*links.columns)
    if base.buckets:
        links = links.repartition(base.buckets, "node")
    return Graph(nodes, edges, kept.unionByName(fresh_vectors), base.dimension, base.similarity, adjacency.unionByName(links), sketches, props, logged=folded.select("kind", "id"), buckets=base.buckets)


@dataclass
class Store:
    """A stored graph at one moment; ``graph`` is its folded state."""

    spark: SparkSession
    path: str
    graph: Graph
    transactions: int
    read_only: bool = False
    next_ids: dict[int, int] = field(default_factory=dict)

    def allocate(self, kind: int) -> int:
        """The next id of a kind; an id that a dropped transaction took is not given again by this handle."""
        if kind not in self.next_ids:
            frame = self.graph.nodes if kind == NODE else self.graph.edges
            top = frame.agg(F.max("id")).first()[0]
            logged = None
            if (log := self.log()) is not None:
                logged = log.where(F.col("kind") == kind).agg(F.max("id")).first()[0]
            self.next_ids[kind] = max(-1 if top is None else top, -1 if logged is None else logged) + 1
        self.next_ids[kind] += 1
        return self.next_ids[kind] - 1

    def log(self) -> DataFrame | None:
        numbers = committed(self.spark, self.path)
        return self.spark.read.schema(LOG_DDL).parquet(*[f"{self.path}/log/txn={n}" for n in numbers]) if numbers else None

    def transaction(self) -> Transaction:
        return Transaction(self)

    def refresh(self) -> None:
        fresh = open_graph(self.spark, self.path)
        self.graph, self.transactions = fresh.graph, fresh.transactions


def open_graph(spark: SparkSession, path: str, read_only: bool = False) -> Store:
    """The graph at a path, with its log folded in."""
    if not exists(spark, f"{path}/meta/_SUCCESS"):
        raise Corrupt(f"{path} holds no complete graph")
    meta = spark.read.schema(META_DDL).parquet(f"{path}/meta").first()
    read = lambda name, ddl: spark.read.schema(ddl).parquet(f"{path}/base/{name}")
    base = Graph(read("nodes", model.NODES_DDL), read("edges", model.EDGES_DDL), read("vectors", model.VECTORS_DDL), meta["dimension"], meta["similarity"], _bucketed(spark, f"{path}/base/adjacency", meta["buckets"]), read("sketch", sketch.SKETCH_DDL), read("props", model.PROPS_TABLE_DDL), meta["transactions"], buckets=meta["buckets"])
    numbers = [n for n in committed(spark, path) if n > meta["transactions"]]
    if not numbers:
        return Store(spark, path, base, meta["transactions"], read_only)
    log = spark.read.schema(LOG_DDL).parquet(*[f"{path}/log/txn={n}" for n in numbers])
    graph = fold(base, log)
    graph.transactions = numbers[-1]
    return Store(spark, path, graph, numbers[-1], read_only)


def compact_to(store: Store, path: str, buckets: int | None = None) -> Store:
    """The folded graph as the base of a new one at a new path."""
    g = store.graph
    bulk_load(store.spark, path, g.nodes, g.edges, g.vectors, g.dimension, g.similarity, buckets, store.transactions)
    return open_graph(store.spark, path)


# --- transactions ------------------------------------------------------------------------


class Transaction:
    """Buffered changes that become visible together, or not at all."""

    def __init__(self, store: Store):
        self.store = store
        self.changes: dict[tuple[int, int], dict[str, Any]] = {}
        self.created: set[tuple[int, int]] = set()

    def _buffer(self, kind: int, identifier: int, **change) -> int:
        if (kind, identifier) in self.changes:
            raise Conflict(f"{'node' if kind == NODE else 'edge'} {identifier} is changed twice in one transaction")
        self.changes[(kind, identifier)] = change
        return identifier

    def _vectors(self, vecs) -> list[list[float]]:
        found = []
        for v in vecs:
            v = [float(x) for x in v]
            if len(v) != self.store.graph.dimension:
                raise InvalidArgument(f"a vector of {len(v)} components in a graph of {self.store.graph.dimension}")
            if any(x != x or x in (float("inf"), float("-inf")) for x in v):
                raise InvalidArgument("a vector component is not finite")
            if self.store.graph.similarity == COSINE and not any(v):
                raise InvalidArgument("a zero vector has no direction")
            found.append(v)
        return found

    def create_node(self, label: str, props: dict[str, Any] | None = None, vecs=()) -> int:
        identifier = self.store.allocate(NODE)
        self.created.add((NODE, identifier))
        return self._buffer(NODE, identifier, op=PUT, label=label, props=props or {}, vecs=self._vectors(vecs))

    def create_edge(self, source: int, target: int, label: str, props: dict[str, Any] | None = None, vecs=()) -> int:
        identifier = self.store.allocate(EDGE)
        self.created.add((EDGE, identifier))
        return self._buffer(EDGE, identifier, op=PUT, source=source, target=target, label=label, props=props or {}, vecs=self._vectors(vecs))

    def update_node(self, identifier: int, label: str, props: dict[str, Any] | None = None, vecs=()) -> None:
        """Replace the whole record."""
        self._buffer(NODE, identifier, op=PUT, label=label, props=props or {}, vecs=self._vectors(vecs))

    def update_edge(self, identifier: int, label: str, props: dict[str, Any] | None = None, vecs=()) -> None:
        """Replace the whole record but for its ends."""
        self._buffer(EDGE, identifier, op=PUT, keep_ends=True, label=label, props=props or {}, vecs=self._vectors(vecs))

    def delete_edge(self, identifier: int) -> None:
        self._buffer(EDGE, identifier, op=DELETE)

    def delete_node(self, identifier: int, detach: bool = False) -> None:
        self._buffer(NODE, identifier, op=DELETE, detach=detach)

    def _live(self, frame: DataFrame, ids: set[int], columns: list[str]) -> dict[int, Any]:
        wanted = self.store.spark.createDataFrame([(i,) for i in sorted(ids)], "id bigint")
        return {r["id"]: r for r in frame.join(F.broadcast(wanted), "id", "left_semi").select(*columns).collect()} if ids else {}

    def commit(self) -> int:
        """Check everything, write the transaction, make it visible; nothing to do is no transaction."""
        store = self.store
        if store.read_only:
            raise InvalidArgument("the graph was opened for reading only")
        if not self.changes:
            return store.transactions
        changed = lambda kind, op: {i for (k, i), c in self.changes.items() if k == kind and c["op"] == op}
        put_nodes, gone_nodes, gone_edges = changed(NODE, PUT), changed(NODE, DELETE), changed(EDGE, DELETE)
        put_edges = {i: c for (k, i), c in self.changes.items() if k == EDGE and c["op"] == PUT}
        new_nodes = {i for k, i in self.created if k == NODE}
        new_edges = {i for k, i in self.created if k == EDGE}
        ends = {e for c in put_edges.values() if "source" in c for e in (c["source"], c["target"])}
        nodes = self._live(store.graph.nodes, (put_nodes | gone_nodes | ends) - new_nodes, ["id"])
        edges = self._live(store.graph.edges, (set(put_edges) | gone_edges) - new_edges, ["id", "source", "target"])
        for i in sorted((put_nodes | gone_nodes) - new_nodes):
            if i not in nodes:
                raise NotFound("node", i)
        for i in sorted((set(put_edges) | gone_edges) - new_edges):
            if i not in edges:
                raise NotFound("edge", i)
        for i, c in put_edges.items():
            if c.get("keep_ends"):
                c["source"], c["target"] = edges[i]["source"], edges[i]["target"]
            for end in (c["source"], c["target"]):
                if end in gone_nodes:
                    raise Conflict(f"edge {i} ends at node {end}, which the transaction deletes")
                if end not in nodes and end not in new_nodes and not c.get("keep_ends"):
                    raise NotFound("node", end)
        number = store.transactions + 1
        rows = []
        for (kind, i), c in self.changes.items():
            props = {k: model.value_row(v) for k, v in c.get("props", {}).items()}
            rows.append((number, ORDER[(c["op"], kind)], c["op"], kind, i, c.get("source"), c.get("target"), c.get("label"), props, c.get("vecs", [])))
        log = store.spark.createDataFrame(rows, LOG_DDL)
        if gone_nodes:
            gone = F.broadcast(store.spark.createDataFrame([(i,) for i in sorted(gone_nodes)], "gone bigint"))
            incident = store.graph.adjacency.join(gone, F.col("node") == F.col("gone")).select(F.col("edge").alias("id"), "gone").distinct()
            other = F.broadcast(store.spark.createDataFrame([(i,) for i in sorted(gone_edges)] or [(-1,)], "id bigint"))
            incident = incident.join(other, "id", "left_anti")
            strict = [i for i in gone_nodes if not self.changes[(NODE, i)]["detach"]]
            blocked = incident.where(F.col("gone").isin(strict)).limit(1).collect() if strict else []
            if blocked:
                raise Conflict(f"node {blocked[0]['gone']} still has edge {blocked[0]['id']}")
            tombs = incident.select("id").distinct().select(F.lit(number).cast("bigint").alias("txn"), F.lit(ORDER[(DELETE, EDGE)]).cast("tinyint").alias("op_order"), F.lit(DELETE).alias("op"), F.lit(EDGE).cast("tinyint").alias("kind"), "id", *[F.lit(None).cast("bigint").alias(c) for c in ("source", "target")], F.lit(None).cast("string").alias("label"), F.expr(f"cast(map() AS {PROPS_DDL})").alias("props"), F.expr("cast(array() AS array<array<float>>)").alias("vecs"))
            log = log.unionByName(tombs)
        log.write.mode("errorifexists").parquet(f"{store.path}/log/txn={number}")
        store.refresh()
        return number


# --- reports -----------------------------------------------------------------------------


def stats(graph: Graph) -> DataFrame:
    """One row: nodes, edges, labels (distinct labels and keys), vectors, transactions."""
    from quiverspark.operators.filters import symbols

    parts = {"nodes": graph.nodes, "edges": graph.edges, "labels": symbols(graph), "vectors": graph.vectors}
    counted = None
    for name, frame in parts.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counted = one if counted is None else counted.unionByName(one)
    row = [F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts]
    return counted.agg(*row).withColumn("transactions", F.lit(graph.transactions).cast("bigint"))


def check(graph: Graph) -> DataFrame:
    """(problem, count) of everything that a sound graph has none of."""
    kinds = ((graph.nodes, NODE, "node"), (graph.edges, EDGE, "edge"))
    found = []
    for frame, kind, name in kinds:
        twice = frame.groupBy("id").count().where("count > 1").agg(F.count("*").alias("n"))
        found.append(twice.select(F.lit(f"duplicate {name} ids").alias("problem"), "n"))
        owners = graph.vectors.where(F.col("kind") == kind).select("id").distinct()
        found.append(owners.join(frame.select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"vectors without their {name}").alias("problem"), "n"))
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id"))
    found.append(ends.join(graph.nodes.select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("edge ends without a node").alias("problem"), "n"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    wrong = graph.vectors.agg(
        F.count_if(F.size("vec") != graph.dimension).alias("vectors of another dimension"),
        F.count_if(F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("vectors that are not finite"),
        F.count_if((F.abs(norm - 1) > 1e-3) if graph.similarity == COSINE else F.lit(False)).alias("vectors that are not of length one"),
    )
    found.append(wrong.unpivot([], wrong.columns, "problem", "n"))
    facets = graph.vectors.groupBy("kind", "id").agg(F.count("*").alias("c"), F.max("facet").alias("top"), F.count_distinct("facet").alias("d")).where("top <> c - 1 OR d <> c")
    found.append(facets.agg(F.count("*").alias("n")).select(F.lit("elements with gaps in their facets").alias("problem"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def verify_integrity(graph: Graph) -> None:
    """Raise if anything is wrong."""
    bad = check(graph).where("n > 0").collect()
    if bad:
        raise Corrupt("; ".join(f"{r['n']} {r['problem']}" for r in bad))


def warm_vector_cache(graph: Graph) -> int:
    """Keep the vectors in memory from now on, as asked; returns their bytes."""
    graph.vectors.persist()
    return graph.vectors.count() * graph.dimension * 4
