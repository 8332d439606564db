"""Registered queries of stores: lifecycle, imports, exports and transactions.

Transactions run on a store of their own, loaded with the fixture's regions, nations, customers
and suppliers; what they leave behind is held against SQL over the raw tables.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark import commands, model
from quiverspark.functions import embedding
from quiverspark.graph import Graph
from quiverspark.model import EDGE, NODE, NODES
from quiverspark.operators import filters
from quiverspark.plans.workspace import new_path, partitions_for
from quiverspark.registry import registered
from quiverspark.sources import files, jsonl, store

LABELS, EDGE_LABELS = ("Region", "Nation", "Customer", "Supplier"), ("LIVES_IN", "BASED_IN", "IN_REGION")
#: Elements that the transactions change: region 2, nation 7, customers 1 and 2, and edges of customer 1, supplier 1.
REGION, NATION, CUSTOMER, GONE, CUT, CHECKED = 16, 57, 10, 18, 11, 12


@dataclass
class Scenario:
    path: str
    store: store.Store


_MADE: dict[int, tuple[Graph, Scenario]] = {}


def scenario(g: Graph) -> Scenario:
    """The store after three transactions, made once for each graph."""
    if id(g) not in _MADE:
        path = new_path(g.spark, "scenario")
        nodes = g.nodes.where(F.col("label").isin(*LABELS))
        edges = g.edges_of(*EDGE_LABELS)
        store.bulk_load(g.spark, path, nodes, edges, g.vectors_of(NODES, "Nation"), g.dimension)
        s = store.open_graph(g.spark, path)
        t = s.transaction()
        a = t.create_node("Area", {"name": "north", "rank": 1}, [[1.0] + [0.0] * (g.dimension - 1)])
        b = t.create_node("Area", {"name": "south", "rank": 2.5})
        t.create_edge(a, NATION, "COVERS", {"since": 1990})
        t.create_edge(b, a, "BORDERS")
        t.update_node(REGION, "Region", {"name": "renamed"})
        t.update_edge(CHECKED, "BASED_IN", {"checked": True})
        t.delete_edge(CUT)
        t.commit()
        t = s.transaction()
        t.update_node(a, "Area", {"name": "north again"})
        t.delete_node(GONE, detach=True)
        t.commit()
        t = s.transaction()
        t.delete_node(b, detach=True)
        t.commit()
        # a torn write, which no reader may see
        fs, p = store._fs(g.spark, f"{path}/log/txn=9/part-0.parquet")
        fs.create(p).close()
        _MADE[id(g)] = g, Scenario(path, s)
    return _MADE[id(g)][1]


#: The state before and after, in SQL: the first new ids follow the largest ones.
AFTER = f"""
, bn AS (SELECT * FROM nodes WHERE label IN {LABELS}), be AS (SELECT * FROM edges WHERE label IN {EDGE_LABELS}),
top AS (SELECT (SELECT max(id) FROM bn) + 1 AS a, (SELECT max(id) FROM bn) + 2 AS b, (SELECT max(id) FROM be) + 1 AS e, (SELECT max(id) FROM be) + 2 AS f),
fn AS (SELECT id, label, CASE id WHEN {REGION} THEN 2 ELSE 1 END AS generation FROM bn WHERE id <> {GONE} UNION ALL SELECT a, 'Area', 2 FROM top),
fe AS (SELECT id, source, target, label, CASE id WHEN {CHECKED} THEN 2 ELSE 1 END AS generation FROM be WHERE id <> {CUT} AND source <> {GONE} AND target <> {GONE} UNION ALL SELECT e, a, {NATION}, 'COVERS', 1 FROM top)
"""


def outcomes(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """(attempt, outcome): the kind of error that each attempt ends with, or ok."""
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, "ok"))
        except model.GraphError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "attempt string, outcome string")


def outcomes_sql(**wanted: str) -> str:
    return "SELECT attempt, outcome FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in wanted.items()) + ") AS t(attempt, outcome)"


# --- lifecycle ------------------------------------------------------------------------------


@registered("s01_create", outcomes_sql(new="ok", again="InvalidArgument", no_dimension="InvalidArgument", unknown_similarity="InvalidArgument"))
def s01(g):
    path = new_path(g.spark, "created")
    return outcomes(g.spark, {
        "new": lambda: store.create(g.spark, path, 4),
        "again": lambda: store.create(g.spark, path, 4),
        "no_dimension": lambda: store.create(g.spark, path + "0", 0),
        "unknown_similarity": lambda: store.create(g.spark, path + "1", 4, "euclid"),
    })


@registered("s02_open", AFTER + "SELECT label, count(*) AS n FROM (SELECT label FROM fn UNION ALL SELECT label FROM fe) GROUP BY label")
def s02(g):
    again = store.open_graph(g.spark, scenario(g).path).graph
    return filters.label_counts(again).unionByName(filters.relationship_counts(again))


@registered("s03_read_only", outcomes_sql(read="ok", commit="InvalidArgument", nothing_there="Corrupt"))
def s03(g):
    locked = store.open_graph(g.spark, scenario(g).path, read_only=True)

    def write():
        t = locked.transaction()
        t.create_node("N")
        t.commit()

    return outcomes(g.spark, {"read": lambda: locked.graph.nodes.count(), "commit": write, "nothing_there": lambda: store.open_graph(g.spark, new_path(g.spark, "nothing"))})


@registered("s04_log_replay", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(7 AS BIGINT)), (2, 3), (3, 2)) AS t(txn, changes)")
def s04(g):
    return store.open_graph(g.spark, scenario(g).path).log().groupBy("txn").agg(F.count("*").alias("changes"))


@registered("s05_compact_to", AFTER + "SELECT CAST(0 AS TINYINT) AS kind, id, label, CAST(generation AS BIGINT) AS generation, CAST(3 AS BIGINT) AS transactions FROM fn UNION ALL SELECT 1, id, label, generation, 3 FROM fe")
def s05(g):
    small = store.compact_to(scenario(g).store, new_path(g.spark, "compacted"))
    both = small.graph.nodes.select(F.lit(NODE).cast("tinyint").alias("kind"), "id", "label", "generation")
    both = both.unionByName(small.graph.edges.select(F.lit(EDGE).cast("tinyint").alias("kind"), "id", "label", "generation"))
    return both.withColumn("transactions", F.lit(small.transactions if small.log() is None else -1).cast("bigint"))


@registered("s18_warm_vector_cache", "SELECT count(*) * 64 * 4 AS bytes FROM owners")
def s18(g):
    size = store.warm_vector_cache(g)
    g.vectors.unpersist()
    return g.spark.createDataFrame([(size,)], "bytes bigint")


# --- files ------------------------------------------------------------------------------------


def _lines(frame: DataFrame, order: list, text, path: str) -> str:
    """Lines in an order, in a folder of files whose names have it, too: no task is given all of them."""
    frame.select(*[c.alias(f"__{i}") if not isinstance(c, str) else F.col(c).alias(f"__{i}") for i, c in enumerate(order)], text.alias("value")).repartitionByRange(partitions_for(frame), *[f"__{i}" for i in range(len(order))]).sortWithinPartitions(*[f"__{i}" for i in range(len(order))]).select("value").write.text(path)
    return path


def _written(spark: SparkSession, path: str, data: bytes) -> str:
    fs, p = store._fs(spark, path)
    out = fs.create(p)
    out.write(bytearray(data))
    out.close()
    return path


@registered("s07_import_jsonl", """
SELECT CAST(0 AS TINYINT) AS kind, CAST(r_regionkey AS BIGINT) AS id, 'Region' AS label, r_name AS name, CAST(r_regionkey AS BIGINT) AS number, r_regionkey + 0.5::DOUBLE AS ratio, CAST(NULL AS BIGINT) AS source, CAST(NULL AS BIGINT) AS target FROM region
UNION ALL SELECT 0, 5 + n_nationkey, 'Nation', n_name, n_nationkey, n_nationkey + 0.5::DOUBLE, NULL, NULL FROM nation
UNION ALL SELECT 0, 30 + c_custkey, 'Customer', c_name, c_custkey, c_custkey + 0.5::DOUBLE, NULL, NULL FROM customer
UNION ALL SELECT 1, n_nationkey, 'IN', NULL, NULL, NULL, 5 + n_nationkey, n_regionkey FROM nation
UNION ALL SELECT 1, 25 + c_custkey, 'LIVES_IN', NULL, NULL, NULL, 30 + c_custkey, 5 + c_nationkey FROM customer""")
def s07(g):
    path = new_path(g.spark, "jsonl")
    of = {label: g.nodes.where(F.col("label") == label).select(F.floor(F.col("id") / 8).alias("key"), F.col("props")["name"]["s"].alias("name"), F.lit(label).alias("label")) for label in ("Region", "Nation", "Customer")}
    rank = F.when(F.col("label") == "Region", 0).when(F.col("label") == "Nation", 1).otherwise(2)
    nodes = of["Region"].unionByName(of["Nation"]).unionByName(of["Customer"])
    # regions have whole numbers as ids, others texts
    body = F.to_json(F.struct("label", F.struct("name", F.col("key").alias("number"), (F.col("key") + 0.5).alias("ratio"), F.lit(True).alias("live")).alias("properties")))
    name = F.when(F.col("label") == "Region", F.col("key").cast("string")).otherwise(F.concat(F.lit('"'), F.substring("label", 1, 1), F.col("key").cast("string"), F.lit('"')))
    n = _lines(nodes, [rank, "key"], F.concat(F.lit('{"id":'), name, F.lit(","), F.substring(body, 2, 1 << 30)), f"{path}/n")
    links = g.edges_of("IN_REGION", "LIVES_IN").select("label", F.floor(F.col("source") / 8).alias("s"), F.floor(F.col("target") / 8).alias("t"))
    nation = F.col("label") == "IN_REGION"
    line = F.when(nation, F.format_string('{"source":"N%d","target":%d,"label":"IN"}', "s", "t")).otherwise(F.format_string('{"source":"C%d","target":"N%d","label":"LIVES_IN"}', "s", "t"))
    e = _lines(links, [F.when(nation, 0).otherwise(1), "s"], line, f"{path}/e")
    made = jsonl.import_jsonl(g.spark, f"{path}/g", n, e, 4).graph
    props = F.col("props")
    told = made.nodes.select(F.lit(NODE).cast("tinyint").alias("kind"), "id", "label", props["name"]["s"].alias("name"), props["number"]["i"].alias("number"), props["ratio"]["f"].alias("ratio"))
    return told.unionByName(made.edges.select(F.lit(EDGE).cast("tinyint").alias("kind"), "id", "label", "source", "target"), allowMissingColumns=True)


def _fbin(g: Graph, path: str) -> str:
    rows = g.vectors_of(NODES, "Nation").select((F.col("facet") * 25 + F.floor(F.col("id") / 8)).alias("vec_id"), "vec").orderBy("vec_id").collect()
    data = struct.pack("<II", len(rows), g.dimension) + b"".join(struct.pack(f"<{g.dimension}f", *r["vec"]) for r in rows)
    return _written(g.spark, path, data)


@registered("s08_import_fbin", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, 'Vector' AS label, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(embedding[64] AS DOUBLE), 5) AS last FROM embeddings")
def s08(g):
    path = new_path(g.spark, "fbin")
    made = files.import_fbin(g.spark, f"{path}/g", _fbin(g, f"{path}/v.fbin")).graph
    first = lambda k: F.round(F.col("vec")[k].cast("double"), 5)
    return made.nodes.join(made.vectors.drop("label"), "id").select("id", "label", first(0).alias("first"), first(63).alias("last"))


@registered("s09_import_node_fbin", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, 'L' || (vec_id % 7) AS label, vec_id AS number FROM embeddings")
def s09(g):
    path = new_path(g.spark, "node_fbin")
    n = g.spark.range(g.vectors_of(NODES, "Nation").count())
    metadata = _lines(n, ["id"], F.format_string('{"label":"L%d","properties":{"number":%d}}', F.col("id") % 7, "id"), f"{path}/m")
    made = files.import_fbin(g.spark, f"{path}/g", _fbin(g, f"{path}/v.fbin"), metadata=metadata).graph
    return made.nodes.select("id", "label", F.col("props")["number"]["i"].alias("number"))


@registered("s10_import_plain_graph", """
, dense AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM nodes)
SELECT CAST(0 AS TINYINT) AS kind, n AS id, id AS external, CAST(NULL AS BIGINT) AS source, CAST(NULL AS BIGINT) AS target FROM dense
UNION ALL SELECT 1, row_number() OVER (ORDER BY e.id) - 1, NULL, s.n, t.n FROM edges e JOIN dense s ON s.id = e.source JOIN dense t ON t.id = e.target""")
def s10(g):
    path = new_path(g.spark, "plain")
    v = _lines(g.nodes.select("id"), ["id"], F.col("id").cast("string"), f"{path}/v")
    e = _lines(g.edges.select("id", "source", "target"), ["id"], F.format_string("%d %d 1.0", "source", "target"), f"{path}/e")
    made = files.import_plain_graph(g.spark, f"{path}/g", v, e).graph
    told = made.nodes.select(F.lit(NODE).cast("tinyint").alias("kind"), "id", F.col("props")["external_id"]["i"].alias("external"))
    return told.unionByName(made.edges.select(F.lit(EDGE).cast("tinyint").alias("kind"), "id", "source", "target"), allowMissingColumns=True)


@registered("s15_export_csv", """
SELECT 'files' AS file, CAST(n_nationkey * 8 + 1 AS VARCHAR) AS a, n_name AS b, CAST(NULL AS VARCHAR) AS c FROM nation
UNION ALL SELECT 'syntax', CAST(p_partkey * 8 + 4 AS VARCHAR), p_type, p_name FROM part
UNION ALL SELECT 'has_syntax', CAST(source AS VARCHAR), CAST(target AS VARCHAR), CAST(id AS VARCHAR) FROM edges WHERE label = 'SUPPLIED_BY'
UNION ALL SELECT 'ast_child', CAST(source AS VARCHAR), CAST(target AS VARCHAR), CAST(id AS VARCHAR) FROM edges WHERE label = 'CONTAINS'""")
def s15(g):
    """Nations and parts stand for files and syntax elements, as the export knows these labels alone."""
    path, props = new_path(g.spark, "csv"), F.col("props")
    nodes = g.nodes.where("label IN ('Nation', 'Part')").withColumn("props", F.when(F.col("label") == "Nation", F.create_map(F.lit("path"), props["name"])).otherwise(F.create_map(F.lit("kind"), props["type"], F.lit("name"), props["name"])))
    nodes = nodes.withColumn("label", F.when(F.col("label") == "Nation", "File").otherwise("Syntax"))
    edges = g.edges.where("label IN ('SUPPLIED_BY', 'CONTAINS')").withColumn("label", F.when(F.col("label") == "CONTAINS", "AST_CHILD").otherwise("HAS_SYNTAX"))
    files.export_csv(Graph(nodes, edges, g.vectors, g.dimension), path)
    read = lambda n: g.spark.read.csv(f"{path}/{n}", header=True, quote='"', escape='"', multiLine=True)
    out = read("files").select(F.lit("files").alias("file"), F.col("id").alias("a"), F.col("path").alias("b"), F.lit(None).cast("string").alias("c"))
    out = out.unionByName(read("syntax").select(F.lit("syntax").alias("file"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("detail").alias("c")))
    for name in ("has_syntax", "ast_child"):
        out = out.unionByName(read(name).select(F.lit(name).alias("file"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("edge_id").alias("c")))
    return out


# --- transactions -----------------------------------------------------------------------------


@registered("m01_create_node", AFTER + "SELECT a AS id, 'Area' AS label, 'north again' AS name, CAST(2 AS BIGINT) AS generation FROM top")
def m01(g):
    return scenario(g).store.graph.nodes.where("label = 'Area'").select("id", "label", F.col("props")["name"]["s"].alias("name"), "generation")


@registered("m02_create_edge", AFTER + f"SELECT e AS id, a AS source, CAST({NATION} AS BIGINT) AS target, 'COVERS' AS label, CAST(1990 AS BIGINT) AS since FROM top")
def m02(g):
    return scenario(g).store.graph.edges.where("label IN ('COVERS', 'BORDERS')").select("id", "source", "target", "label", F.col("props")["since"]["i"].alias("since"))


@registered("m03_update", f"SELECT CAST(0 AS TINYINT) AS kind, CAST(r_regionkey AS BIGINT) * 8 AS id, CASE r_regionkey * 8 WHEN {REGION} THEN 'renamed' ELSE r_name END AS name, FALSE AS checked FROM region UNION ALL SELECT 1, s_suppkey * 8 + 4, NULL, s_suppkey * 8 + 4 = {CHECKED} FROM supplier")
def m03(g):
    after = scenario(g).store.graph
    checked = F.coalesce(F.col("props")["checked"]["tag"] == model.TRUE, F.lit(False)).alias("checked")
    regions = after.nodes.where("label = 'Region'").select(F.lit(NODE).cast("tinyint").alias("kind"), "id", F.col("props")["name"]["s"].alias("name"), checked)
    return regions.unionByName(after.edges.where("label = 'BASED_IN'").select(F.lit(EDGE).cast("tinyint").alias("kind"), "id", F.lit(None).cast("string").alias("name"), checked))


@registered("m04_delete_detach", AFTER + "SELECT id, source, target, label FROM fe")
def m04(g):
    return scenario(g).store.graph.edges.select("id", "source", "target", "label")


@registered("m05_delete_edge", f"SELECT c_custkey * 8 + 3 AS id FROM customer WHERE c_custkey * 8 + 3 <> {CUT} AND c_custkey * 8 + 2 <> {GONE}")
def m05(g):
    return scenario(g).store.graph.edges.where("label = 'LIVES_IN'").select("id")


@registered("m06_conflicts", outcomes_sql(twice="Conflict", end_deleted="Conflict", still_has_edges="Conflict", no_such_node="NotFound", no_such_edge="NotFound", no_such_end="NotFound", deleted_before="NotFound", wrong_length="InvalidArgument", zero_vector="InvalidArgument", not_finite="InvalidArgument", no_scalar="InvalidArgument"))
def m06(g):
    s = scenario(g).store

    def attempt(*steps: Callable[[store.Transaction], object]) -> Callable[[], None]:
        def run():
            t = s.transaction()
            for step in steps:
                step(t)
            t.commit()

        return run

    return outcomes(g.spark, {
        "twice": attempt(lambda t: t.update_node(NATION, "Nation"), lambda t: t.delete_node(NATION)),
        "end_deleted": attempt(lambda t: t.delete_node(CUSTOMER, detach=True), lambda t: t.create_edge(CUSTOMER, NATION, "X")),
        "still_has_edges": attempt(lambda t: t.delete_node(NATION)),
        "no_such_node": attempt(lambda t: t.update_node(1 << 60, "N")),
        "no_such_edge": attempt(lambda t: t.delete_edge(1 << 60)),
        "no_such_end": attempt(lambda t: t.create_edge(1 << 60, NATION, "X")),
        "deleted_before": attempt(lambda t: t.update_node(GONE, "Customer")),
        "wrong_length": attempt(lambda t: t.create_node("N", vecs=[[1.0]])),
        "zero_vector": attempt(lambda t: t.create_node("N", vecs=[[0.0] * g.dimension])),
        "not_finite": attempt(lambda t: t.create_node("N", vecs=[[float("nan")] * g.dimension])),
        "no_scalar": attempt(lambda t: t.create_node("N", {"x": [1]})),
    })


@registered("m07_canonical_order", AFTER + f""", l(txn, place, op, kind, id) AS (
  SELECT 1, 0, 'put', 0, a FROM top UNION ALL SELECT 1, 0, 'put', 0, b FROM top UNION ALL SELECT 1, 0, 'put', 0, {REGION}
  UNION ALL SELECT 1, 1, 'put', 1, e FROM top UNION ALL SELECT 1, 1, 'put', 1, f FROM top UNION ALL SELECT 1, 1, 'put', 1, {CHECKED} UNION ALL SELECT 1, 2, 'delete', 1, {CUT}
  UNION ALL SELECT 2, 0, 'put', 0, a FROM top UNION ALL SELECT 2, 2, 'delete', 1, c_custkey * 8 + 3 FROM customer WHERE c_custkey * 8 + 2 = {GONE} UNION ALL SELECT 2, 3, 'delete', 0, {GONE}
  UNION ALL SELECT 3, 2, 'delete', 1, f FROM top UNION ALL SELECT 3, 3, 'delete', 0, b FROM top)
SELECT CAST(txn AS BIGINT) AS txn, row_number() OVER (PARTITION BY txn ORDER BY place, id) AS at, op, CAST(kind AS TINYINT) AS kind, CAST(id AS BIGINT) AS id FROM l""")
def m07(g):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("txn").orderBy("op_order", "id")).cast("bigint").alias("at")
    return scenario(g).store.log().select("txn", at, "op", "kind", "id")


@registered("m08_commit", AFTER + "SELECT (SELECT count(*) FROM fn) AS nodes, (SELECT count(*) FROM fe) AS edges, (SELECT count(*) FROM embeddings) AS vectors, CAST(3 AS BIGINT) AS transactions")
def m08(g):
    return store.stats(scenario(g).store.graph).select("nodes", "edges", "vectors", "transactions")


@registered("m09_fold", AFTER + "SELECT CAST(0 AS TINYINT) AS kind, id, label, CAST(generation AS BIGINT) AS generation FROM fn UNION ALL SELECT 1, id, label, generation FROM fe")
def m09(g):
    after = scenario(g).store.graph
    return after.nodes.select(F.lit(NODE).cast("tinyint").alias("kind"), "id", "label", "generation").unionByName(after.edges.select(F.lit(EDGE).cast("tinyint").alias("kind"), "id", "label", "generation"))


@registered("m10_adjacency", AFTER + "SELECT source AS node, CAST(0 AS TINYINT) AS direction, target AS neighbor, id AS edge, label FROM fe UNION ALL SELECT target, 1, source, id, label FROM fe")
def m10(g):
    return scenario(g).store.graph.adjacency.select("node", "direction", "neighbor", "edge", "label")


@registered("m10_walk_after_transactions", AFTER + f"SELECT id, source, target, label FROM fe WHERE source = {NATION} OR target = {NATION}")
def m10w(g):
    return filters.neighbors(scenario(g).store.graph, NATION).select("id", "source", "target", "label")


# --- commands and embedders ---------------------------------------------------------------------


@registered("q04_commands", AFTER + f""", c AS (
  SELECT 'neighbors' AS command, id FROM fe WHERE source = {NATION} OR target = {NATION}
  UNION ALL SELECT 'node', {CUSTOMER}
  UNION ALL SELECT 'query', source FROM (SELECT source FROM fe WHERE label = 'BASED_IN' ORDER BY id LIMIT 5)
  UNION ALL SELECT 'numeric-range', id FROM (SELECT c_custkey * 8 + 2 AS id FROM customer WHERE c_acctbal >= 9000 AND c_custkey * 8 + 2 <> {GONE} UNION ALL SELECT s_suppkey * 8 + 3 FROM supplier WHERE s_acctbal >= 9000 ORDER BY id LIMIT 7))
SELECT command, CAST(id AS BIGINT) AS id FROM c""")
def q04(g):
    path = scenario(g).path
    lines = {"neighbors": [str(NATION)], "node": [str(CUSTOMER)], "query": ["MATCH (s:Supplier)-[b:BASED_IN]->(n:Nation) RETURN s LIMIT 5"], "numeric-range": ["acctbal", "--lower", "9000", "--limit", "7"]}
    out = None
    for name, arguments in lines.items():
        found = commands.run(g.spark, commands.parsed([path, name, *arguments]))
        one = found.select(F.lit(name).alias("command"), F.col("start" if name == "query" else "id").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


@registered("e02_remote_embedder", "SELECT o_orderkey * 8 + 5 AS id, length(o_orderpriority) AS first FROM orders")
def e02(g):
    def call(texts, dimension):
        return [[float(len(t)), *[1.0] * (dimension - 1)] for t in texts]

    rows = g.nodes.where("label = 'Order'").select("id", F.col("props")["priority"]["s"].alias("priority"))
    return embedding.embed_unique(rows, "priority", embedding.remote_embedder(call), 8).select("id", F.col("embedding")[0].cast("bigint").alias("first"))
