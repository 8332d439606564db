"""Registered queries of the graph engine over the fixture graph, with SQL for each that SQL can express.

decimals where results are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverspark.functions import embedding, text
from quiverspark.graph import Graph
from quiverspark.model import BOTH, EDGE, EDGES, NODE, NODES, OUT
from quiverspark.operators import analytics, explore, filtered, filters, pattern, semantic, sketch, traverse, vectors
from quiverspark.operators.filters import ElementFilter, Range
from quiverspark.registry import ORACLES, QUERIES, Query, registered
from quiverspark.sources import files, store
from quiverspark.sources.fixture import CODES

NATION_7, CUSTOMER_1, ORDER_5, PART_3, REGION_2 = 7 * 8 + CODES["Nation"], 1 * 8 + CODES["Customer"], 5 * 8 + CODES["Order"], 3 * 8 + CODES["Part"], 2 * 8 + CODES["Region"]
QUERY_VECTORS = (7, 42)


def _vector(graph: Graph, vec_id: int) -> list[float]:
    """The fixture's vector of an embeddings row: nation vec_id % 25 owns it as facet vec_id // 25."""
    row = graph.vectors_of(NODES, "Nation").where((F.col("id") == (vec_id % 25) * 8 + 1) & (F.col("facet") == vec_id // 25)).first()
    return [float(x) for x in row["vec"]]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


# Values of nodes in SQL, by key, for predicates.
PROPS_SQL = """
, floats AS (
  SELECT p_partkey * 8 + 4 AS id, 'price' AS key, p_retailprice AS f FROM part
  UNION ALL SELECT c_custkey * 8 + 2, 'acctbal', c_acctbal FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, 'acctbal', s_acctbal FROM supplier
  UNION ALL SELECT o_orderkey * 8 + 5, 'total', o_totalprice FROM orders),
texts AS (
  SELECT p_partkey * 8 + 4 AS id, 'Part' AS label, 'name' AS key, p_name AS s FROM part
  UNION ALL SELECT p_partkey * 8 + 4, 'Part', 'brand', p_brand FROM part
  UNION ALL SELECT p_partkey * 8 + 4, 'Part', 'type', p_type FROM part
  UNION ALL SELECT c_custkey * 8 + 2, 'Customer', 'name', c_name FROM customer
  UNION ALL SELECT c_custkey * 8 + 2, 'Customer', 'segment', c_mktsegment FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, 'Supplier', 'name', s_name FROM supplier
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, 'Nation', 'name', n_name FROM nation
  UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 8, 'Region', 'name', r_name FROM region
  UNION ALL SELECT o_orderkey * 8 + 5, 'Order', 'status', o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey * 8 + 5, 'Order', 'priority', o_orderpriority FROM orders)
"""


def _hits_sql(where: str = "TRUE", vec_id: int = 7, k: int = 10) -> str:
    """Exact search in SQL, with the rule for ties at the cut."""
    return f"""
, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {vec_id}),
s AS (SELECT kind, id, facet, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9) AS score FROM owners JOIN embeddings USING (vec_id) CROSS JOIN q WHERE {where}),
b AS (SELECT kind, id, facet, score FROM s QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY score DESC, facet) = 1),
t AS (SELECT * FROM b ORDER BY score DESC, kind DESC, id DESC LIMIT {k})
SELECT CAST(kind AS TINYINT) AS kind, id, CAST(facet AS INTEGER) AS facet, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, kind, id) AS INTEGER) AS rank FROM t"""


# --- S: sources, sinks, lifecycle -----------------------------------------------------------


@registered("s06_bulk_ids", "SELECT label, count(*) AS n, min(id) AS lowest, max(id) AS highest, CAST(sum(id) AS BIGINT) AS total FROM edges GROUP BY label")
def s06(g):
    return g.edges.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("lowest"), F.max("id").alias("highest"), F.sum("id").alias("total"))


@registered("s13_ranked_upsert", "SELECT o_custkey AS key, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, min(o_orderkey) AS place FROM orders GROUP BY o_custkey")
def s13(g):
    orders = g.nodes.where("label = 'Order'").select(((F.col("id") - 5) / 8).cast("bigint").alias("seq"), F.col("props")["total"]["f"].alias("rank"), F.col("id").alias("target"))
    placed = g.edges.where("label = 'PLACED'").select("target", ((F.col("source") - 2) / 8).cast("bigint").alias("key"))
    best = files.ranked_upsert(orders.join(placed, "target"))
    return best.select("key", F.col("seq").alias("o_orderkey"), "place")


@registered("s14_edge_dedup", "SELECT min(id) AS id, source, label, target FROM edges GROUP BY source, label, target")
def s14(g):
    return files.first_edges(g.edges.select("id", "source", "label", "target", F.col("id").alias("seq"))).select("id", "source", "label", "target")


@registered("s16_stats", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, CAST(12 + 13 AS BIGINT) AS labels, (SELECT count(*) FROM owners) AS vectors, CAST(0 AS BIGINT) AS transactions")
def s16(g):
    return store.stats(g)


@registered("s17_check", """, p AS (
  SELECT 'duplicate node ids' AS problem, count(*) AS n FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate edge ids', count(*) FROM (SELECT id FROM edges GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'edge ends without a node', count(*) FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT 'vectors without their node', count(DISTINCT id) FROM owners WHERE kind = 0 AND id NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT 'vectors without their edge', count(DISTINCT id) FROM owners WHERE kind = 1 AND id NOT IN (SELECT id FROM edges)
  UNION ALL SELECT 'vectors of another dimension', count_if(len(embedding) <> 64) FROM owners JOIN embeddings USING (vec_id)
  UNION ALL SELECT 'vectors that are not finite', count_if(len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) FROM owners JOIN embeddings USING (vec_id)
  UNION ALL SELECT 'vectors that are not of length one', count_if(abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-3) FROM owners JOIN embeddings USING (vec_id)
  UNION ALL SELECT 'elements with gaps in their facets', count(*) FROM (SELECT kind, id FROM owners GROUP BY kind, id HAVING max(facet) <> count(*) - 1 OR count(DISTINCT facet) <> count(*)))
SELECT problem, CAST(n AS BIGINT) AS n FROM p""")
def s17(g):
    return store.check(g)


@registered("s20_content", "SELECT o_orderkey * 8 + 5 AS id, CAST(epoch_ms(CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)) AS BIGINT) AS date_ms, trim(o_orderpriority) AS priority FROM orders")
def s20(g):
    props = F.col("props")
    return g.nodes.where("label = 'Order'").select("id", text.epoch_millis(props["date"]["s"]).alias("date_ms"), text.bounded_bytes(props["priority"]["s"], text.SUMMARY_BYTES).alias("priority"))


# --- R: point reads ---------------------------------------------------------------------------


@registered("r01_node", f"SELECT n.id, n.label, n_name AS name FROM nodes n JOIN nation ON n.id = CAST(n_nationkey AS BIGINT) * 8 + 1 WHERE n.id = {NATION_7}")
def r01(g):
    return filters.node(g, NATION_7).select("id", "label", F.col("props")["name"]["s"].alias("name"))


@registered("r01_edge", f"SELECT id, source, target, label FROM edges WHERE id = {5 * 8}")
def r01e(g):
    return filters.edge(g, 5 * 8).select("id", "source", "target", "label")


@registered("r02_node_ids", "SELECT id FROM nodes ORDER BY id")
def r02(g):
    return filters.node_ids(g)


@registered("r02_edge_ids", "SELECT id FROM edges ORDER BY id")
def r02e(g):
    return filters.edge_ids(g)


@registered("r03_node_vector", f"SELECT CAST(facet AS INTEGER) AS facet, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM owners JOIN embeddings USING (vec_id) WHERE kind = 0 AND id = {NATION_7} AND facet = 3")
def r03(g):
    return filters.vector(g, NODE, NATION_7, 3).select("facet", F.round(F.col("vec")[0].cast("double"), 6).alias("first"), F.round(F.col("vec")[63].cast("double"), 6).alias("last"))


@registered("r04_symbols", "SELECT symbol FROM (SELECT DISTINCT label AS symbol FROM nodes UNION SELECT DISTINCT label FROM edges UNION SELECT unnest(['name', 'acctbal', 'segment', 'brand', 'type', 'size', 'price', 'status', 'total', 'priority', 'date', 'date_ms', 'quantity']))")
def r04(g):
    return filters.symbols(g)


@registered("r05_nodes_with_label", "SELECT id, label FROM nodes WHERE label = 'Supplier' ORDER BY id DESC")
def r05(g):
    return filters.nodes_with_label(g, "Supplier").select("id", "label")


@registered("r06_property", "SELECT CAST(p_partkey * 8 + 4 AS BIGINT) AS id, p_size AS value FROM part")
def r06(g):
    return filters.property_of(g.nodes.where("label = 'Part'"), "size").select("id", F.col("value")["i"].cast("int").alias("value"))


@registered("r07_neighbors", f"SELECT id, source, target, label FROM edges WHERE source = {NATION_7} OR target = {NATION_7}")
def r07(g):
    return filters.neighbors(g, NATION_7).select("id", "source", "target", "label")


@registered("r08_visit_neighbors", f"SELECT neighbor, edge FROM walk WHERE node = {CUSTOMER_1} AND direction = 0 AND label = 'PLACED'")
def r08(g):
    return filters.visit_neighbors(g, CUSTOMER_1, OUT, "PLACED")


# --- P: predicates and sets -----------------------------------------------------------------

AS_SET = "SELECT CAST(kind AS TINYINT) AS kind, id FROM"


@registered("p01_elements_with_label", f"{AS_SET} (SELECT 1 AS kind, id FROM edges WHERE label = 'CONTAINS')")
def p01(g):
    return filters.elements_with_label(g, "CONTAINS")


@registered("p02_elements_matching", f"{AS_SET} (SELECT 0 AS kind, p_partkey * 8 + 4 AS id FROM part WHERE p_size = 10)")
def p02(g):
    return filters.elements_matching(g, ElementFilter("Part", (("size", 10),)))


@registered("p02_types_never_mix", f"{AS_SET} (SELECT 0 AS kind, CAST(1 AS BIGINT) AS id WHERE FALSE)")
def p02t(g):
    return filters.elements_matching(g, ElementFilter("Part", (("size", 10.0),)))


@registered("p02_edges_matching", f"{AS_SET} (SELECT 1 AS kind, ord * 8 + 1 AS id FROM li WHERE l_quantity = 20)")
def p02e(g):
    return filters.elements_matching(g, ElementFilter(None, (("quantity", 20.0),)), EDGES)


@registered("p04_numeric_range", f"{AS_SET} (SELECT 0 AS kind, p_partkey * 8 + 4 AS id FROM part WHERE p_retailprice >= 1000 AND p_retailprice < 1500 UNION ALL SELECT 1, ord * 8 + 1 FROM li WHERE l_extendedprice >= 1000 AND l_extendedprice < 1500)")
def p04(g):
    return filters.elements_in_range(g, Range("price", 1000.0, 1500.0, upper_inclusive=False))


@registered("p04_integer_range", f"{AS_SET} (SELECT 0 AS kind, p_partkey * 8 + 4 AS id FROM part WHERE p_size > 40)")
def p04i(g):
    return filters.elements_in_range(g, Range("size", 40, lower_inclusive=False))


def _two_sets(g):
    return filters.elements_matching(g, ElementFilter("Customer", (("segment", "BUILDING"),))), filters.elements_in_range(g, Range("acctbal", 0.0, None))


_SETS = ", a AS (SELECT 0 AS kind, c_custkey * 8 + 2 AS id FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT 0 AS kind, c_custkey * 8 + 2 AS id FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 0, s_suppkey * 8 + 3 FROM supplier WHERE s_acctbal >= 0) "


@registered("p07_union", f"{_SETS} {AS_SET} (SELECT * FROM a UNION SELECT * FROM b)")
def p07u(g):
    return filters.union(*_two_sets(g))


@registered("p07_intersection", f"{_SETS} {AS_SET} (SELECT * FROM a INTERSECT SELECT * FROM b)")
def p07i(g):
    return filters.intersection(*_two_sets(g))


@registered("p07_difference", f"{_SETS} {AS_SET} (SELECT * FROM a EXCEPT SELECT * FROM b)")
def p07d(g):
    return filters.difference(*_two_sets(g))


@registered("p08_set_sizes", f"{_SETS} SELECT count(*) FILTER (kind = 0) AS nodes, count(*) FILTER (kind = 1) AS edges FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT 1, 8 UNION SELECT 0, 2)")
def p08(g):
    full = filters.insert(filters.insert(filters.union(*_two_sets(g)), EDGE, 8), NODE, 2)
    return full.agg(F.count_if(F.col("kind") == 0).alias("nodes"), F.count_if(F.col("kind") == 1).alias("edges"))


@registered("p09_numeric_range_report", f"{AS_SET} (SELECT 0 AS kind, o_orderkey * 8 + 5 AS id FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 ORDER BY id LIMIT 50)")
def p09(g):
    return filters.numeric_range(g, Range("total", 1000.0, 200000.0), 50)


# --- V: vector search -------------------------------------------------------------------------


@registered("v01_vector_search", _hits_sql())
def v01(g):
    return _rounded(vectors.vector_search(g, _vector(g, 7), 10), "score")


@registered("v01_nodes_with_label", _hits_sql("kind = 0 AND owners.label = 'Part'"))
def v01l(g):
    return _rounded(vectors.vector_search(g, _vector(g, 7), 10, NODES, "Part"), "score")


@registered("v01_many_queries", """
, q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, kind, id, facet, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9) AS score FROM owners JOIN embeddings USING (vec_id) CROSS JOIN q WHERE kind = 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, kind, id ORDER BY score DESC, facet) = 1),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, kind DESC, id DESC) <= 10)
SELECT CAST(query // 20 AS INTEGER) AS query, CAST(kind AS TINYINT) AS kind, id, CAST(facet AS INTEGER) AS facet, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, kind, id) AS INTEGER) AS rank FROM t""")
def v01m(g):
    """Every twentieth vector asks, all in one job."""
    asked = g.vectors_of(NODES, "Nation").select((F.col("facet") * 25 + F.floor(F.col("id") / 8)).alias("vec_id"), "vec").where("vec_id % 20 = 0").orderBy("vec_id").collect()
    return _rounded(vectors.vector_search_many(g, [[float(x) for x in r["vec"]] for r in asked], 10, NODES), "score")


@registered("v02_vector_search_within", _hits_sql("kind = 0 AND id IN (SELECT p_partkey * 8 + 4 FROM part WHERE p_size <= 10)"))
def v02(g):
    return _rounded(vectors.vector_search_within(g, _vector(g, 7), filters.elements_in_range(g, Range("size", None, 10)), 10), "score")


@registered("v05_vector_search_adaptive", _hits_sql(vec_id=42))
def v05(g):
    return _rounded(sketch.vector_search_adaptive(g, _vector(g, 42), 10)[0], "score")


@registered("v08_vector_search_filtered", _hits_sql("kind = 0 AND id IN (SELECT p_partkey * 8 + 4 FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice >= 905)"))
def v08(g):
    return _rounded(filtered.vector_search_filtered(g, _vector(g, 7), 10, ElementFilter("Part"), [Range("size", 5, 30), Range("price", 905.0)]).hits, "score")


def _late_sql(where: str = "TRUE") -> str:
    return f"""
, q AS (SELECT vec_id AS i, CASE vec_id WHEN 7 THEN 0.75 ELSE 0.25 END AS w, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (7, 42)),
s AS (SELECT i, w, kind, id, facet, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9) AS score FROM owners JOIN embeddings USING (vec_id) CROSS JOIN q WHERE {where}),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY i, kind, id ORDER BY score DESC, facet) = 1),
e AS (SELECT kind, id, round(sum(score * w), 9) AS score, max(CASE i WHEN 7 THEN facet END) AS facet_0, max(CASE i WHEN 42 THEN facet END) AS facet_1 FROM b GROUP BY kind, id),
t AS (SELECT * FROM e ORDER BY score DESC, kind DESC, id DESC LIMIT 10)
SELECT CAST(kind AS TINYINT) AS kind, id, round(score, 6) AS score, CAST(facet_0 AS INTEGER) AS facet_0, CAST(facet_1 AS INTEGER) AS facet_1, CAST(row_number() OVER (ORDER BY score DESC, kind, id) AS INTEGER) AS rank FROM t"""


def _late(hits: DataFrame) -> DataFrame:
    return _rounded(hits, "score").select("kind", "id", "score", F.col("facets")[0].alias("facet_0"), F.col("facets")[1].alias("facet_1"), "rank")


def _late_queries(g):
    return [_vector(g, i) for i in QUERY_VECTORS]


@registered("v09_late_interaction", _late_sql())
def v09(g):
    return _late(vectors.late_interaction_search(g, _late_queries(g), 10, [3, 1]))


@registered("v10_late_interaction_within", _late_sql("kind = 0 AND id IN (SELECT s_suppkey * 8 + 3 FROM supplier)"))
def v10(g):
    return _late(vectors.late_interaction_search(g, _late_queries(g), 10, [3, 1], within=filters.elements_with_label(g, "Supplier")))


@registered("v12_late_interaction_adaptive", _late_sql())
def v12(g):
    return _late(sketch.late_interaction_adaptive(g, _late_queries(g), 10, [3, 1])[0])




# --- T: traversal ------------------------------------------------------------------------------


@registered("t01_expand", f"{AS_SET} (SELECT DISTINCT 0 AS kind, neighbor AS id FROM walk WHERE node IN ({CUSTOMER_1}, {NATION_7}) UNION SELECT 1, edge FROM walk WHERE node IN ({CUSTOMER_1}, {NATION_7}))")
def t01(g):
    return traverse.expand(g, filters.element_set(g, [CUSTOMER_1, NATION_7]))


@registered("t02_expand_hops", f""", h1 AS (SELECT DISTINCT neighbor AS node FROM walk WHERE node = {CUSTOMER_1} AND neighbor <> {CUSTOMER_1}),
h2 AS (SELECT DISTINCT neighbor AS node FROM walk WHERE node IN (SELECT node FROM h1) AND neighbor <> {CUSTOMER_1} AND neighbor NOT IN (SELECT node FROM h1))
{AS_SET} (SELECT 0 AS kind, node AS id FROM h1 UNION SELECT 0, node FROM h2 UNION SELECT 1, edge FROM walk WHERE node = {CUSTOMER_1} OR node IN (SELECT node FROM h1))""")
def t02(g):
    return traverse.expand_hops(g, filters.element_set(g, [CUSTOMER_1]), 2)


@registered("t03_nodes_within_hops", f""", h1 AS (SELECT DISTINCT neighbor AS node FROM walk WHERE node = {ORDER_5} AND direction = 0),
h2 AS (SELECT DISTINCT neighbor AS node FROM walk WHERE node IN (SELECT node FROM h1) AND direction = 0)
{AS_SET} (SELECT 0 AS kind, id FROM nodes WHERE label = 'Supplier' AND (id IN (SELECT node FROM h1) OR id IN (SELECT node FROM h2)))""")
def t03(g):
    return traverse.nodes_within_hops(g, filters.element_set(g, [ORDER_5]), 2, OUT, include_seeds=False, wanted=ElementFilter("Supplier"))


@registered("t04_graph_range_search", f""", h1 AS (SELECT DISTINCT neighbor AS node FROM walk WHERE node = {NATION_7}),
h2 AS (SELECT DISTINCT neighbor AS node FROM walk WHERE node IN (SELECT node FROM h1)) {_hits_sql(f"kind = 0 AND (id = {NATION_7} OR id IN (SELECT node FROM h1) OR id IN (SELECT node FROM h2))")}""")
def t04(g):
    return _rounded(traverse.vector_search_graph_range(g, _vector(g, 7), filters.element_set(g, [NATION_7])).hits, "score")


def _path_row(g: Graph, p: traverse.ShortestPath) -> DataFrame:
    row = (p.termination, p.strategy, len(p.edges) if p.edges is not None else -1, p.nodes, p.edges)
    return g.spark.createDataFrame([row], "termination string, strategy string, hops int, nodes array<bigint>, edges array<bigint>")


PATH_PAIRS = [(CUSTOMER_1, PART_3), (CUSTOMER_1, REGION_2), (ORDER_5, NATION_7)]


@registered("t05_shortest_path_hops", """, pairs(a, b) AS (VALUES """ + ", ".join(f"({a}, {b})" for a, b in PATH_PAIRS) + """),
d1 AS (SELECT a, b, a AS node, 0 AS d FROM pairs),
d2 AS (SELECT a, b, node, min(d) AS d FROM (SELECT * FROM d1 UNION ALL SELECT a, b, neighbor, d + 1 FROM d1 JOIN walk USING (node)) GROUP BY a, b, node),
d3 AS (SELECT a, b, node, min(d) AS d FROM (SELECT * FROM d2 UNION ALL SELECT a, b, neighbor, d + 1 FROM d2 JOIN walk USING (node)) GROUP BY a, b, node),
d4 AS (SELECT a, b, node, min(d) AS d FROM (SELECT * FROM d3 UNION ALL SELECT a, b, neighbor, d + 1 FROM d3 JOIN walk USING (node)) GROUP BY a, b, node)
SELECT CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", CAST(coalesce((SELECT min(d) FROM d4 x WHERE x.a = p.a AND x.b = p.b AND x.node = p.b), -1) AS INTEGER) AS hops FROM pairs p""")
def t05(g):
    rows = [(a, b, len(p.edges) if p.edges is not None else -1) for a, b in PATH_PAIRS for p in [traverse.shortest_path(g, a, b, max_hops=3)]]
    return g.spark.createDataFrame(rows, "start bigint, end bigint, hops int")


@registered("t06_one_sided_path", f"SELECT 'found' AS termination, 'breadth_first' AS strategy, CAST(1 AS INTEGER) AS hops, [{CUSTOMER_1}, target] AS nodes, [min(id)] AS edges FROM edges WHERE source = {CUSTOMER_1} AND label = 'LIVES_IN' GROUP BY target")
def t06(g):
    target = g.edges.where((F.col("source") == CUSTOMER_1) & (F.col("label") == "LIVES_IN")).first()["target"]
    return _path_row(g, traverse.shortest_path(g, CUSTOMER_1, target, max_hops=1))


@registered("t09_match_one_hop", "SELECT source AS start, id AS edge, target AS \"end\" FROM edges WHERE label = 'PLACED' AND source IN (SELECT c_custkey * 8 + 2 FROM customer WHERE c_mktsegment = 'BUILDING') AND target IN (SELECT o_orderkey * 8 + 5 FROM orders WHERE o_orderstatus = 'O') ORDER BY edge, start, \"end\" LIMIT 1000")
def t09(g):
    return pattern.match_one_hop(g, pattern.OneHop(ElementFilter("Customer", (("segment", "BUILDING"),)), "PLACED", ElementFilter("Order", (("status", "O"),)), limit=1000))


@registered("t09_match_undirected", "SELECT node AS start, edge, neighbor AS \"end\" FROM walk WHERE label = 'IN_REGION' ORDER BY edge, start, \"end\"")
def t09u(g):
    return pattern.match_one_hop(g, pattern.OneHop(edge_label="IN_REGION", direction=BOTH, limit=1000))


@registered("t09_match_all", "SELECT source AS start, id AS edge, target AS \"end\" FROM edges WHERE label = 'CONTAINS' AND target IN (SELECT p_partkey * 8 + 4 FROM part WHERE p_size = 10)")
def t09a(g):
    return pattern.matches(g, pattern.OneHop(ElementFilter("Order"), "CONTAINS", ElementFilter("Part", (("size", 10),))))


@registered("t11_semantic_one_hop", """
, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7),
s AS (SELECT kind, id, max(round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9)) AS score FROM owners JOIN embeddings USING (vec_id) CROSS JOIN q GROUP BY kind, id),
seeds AS (SELECT s.id, s.score FROM s JOIN nodes USING (id) WHERE kind = 0 AND label = 'Part' ORDER BY score DESC, id DESC LIMIT 64),
m AS (SELECT w.node AS start, w.edge, w.neighbor AS "end", seeds.score AS start_score, e.score AS edge_score, t.score AS end_score FROM walk w JOIN seeds ON w.node = seeds.id
  LEFT JOIN s e ON e.kind = 1 AND e.id = w.edge LEFT JOIN s t ON t.kind = 0 AND t.id = w.neighbor WHERE w.label = 'SUPPLIED_BY' AND w.direction = 0),
r AS (SELECT *, round((start_score * 0.5 + coalesce(edge_score * 0.25, 0) + coalesce(end_score * 0.25, 0)) / (0.5 + CASE WHEN edge_score IS NULL THEN 0 ELSE 0.25 END + CASE WHEN end_score IS NULL THEN 0 ELSE 0.25 END), 9) AS score FROM m)
SELECT start, edge, "end", round(score, 6) AS score, round(start_score, 6) AS start_score, round(edge_score, 6) AS edge_score, round(end_score, 6) AS end_score FROM r ORDER BY r.score DESC, start, edge, "end" LIMIT 50""")
def t11(g):
    return _rounded(pattern.match_semantic_one_hop(g, _vector(g, 7), pattern.OneHop(ElementFilter("Part"), "SUPPLIED_BY", limit=50)), "score", "start_score", "edge_score", "end_score")


@registered("t12_semantic_paths")
def t12(g):
    return _rounded(semantic.semantic_paths(g, _vector(g, 7), semantic.SemanticPathOptions(seed_count=8, edge_label="SUPPLIED_BY")), "score", "seed_score")


@registered("t13_degree", "SELECT n.id AS node, count(w.edge) AS degree FROM nodes n LEFT JOIN walk w ON w.node = n.id GROUP BY n.id")
def t13(g):
    return filters.degrees(g)


# --- Q: the query language ------------------------------------------------------------------------


@registered("q02_query", "SELECT source AS start, id AS edge, target AS \"end\" FROM edges WHERE label = 'PLACED' ORDER BY edge LIMIT 10")
def q02(g):
    return pattern.query(g, "MATCH (c:Customer)-[r:PLACED]->(o:Order) RETURN c, r, o LIMIT 10")


@registered("q02_query_incoming", "SELECT target AS start, id AS edge, source AS \"end\" FROM edges WHERE label = 'BASED_IN' ORDER BY edge LIMIT 20")
def q02i(g):
    return pattern.query(g, "match (n:Nation)<-[b:BASED_IN]-(s:Supplier) return n limit 20;")


@registered("q02_unknown_label", "SELECT id AS start, id AS edge, id AS \"end\" FROM nodes WHERE FALSE")
def q02u(g):
    return pattern.query(g, "MATCH (c:Nobody)-[r:PLACED]->(o:Order) RETURN c")


@registered("q05_concise", f"""{PROPS_SQL} SELECT n.id, n.label, t.s AS concise FROM nodes n LEFT JOIN texts t ON t.id = n.id AND t.key = 'name'""")
def q05(g):
    return pattern.concise(g.nodes).select("id", "label", "concise")


# --- G: analytics ---------------------------------------------------------------------------------


@registered("g01_bfs", f""", reach(node, distance) USING KEY (node) AS (
  SELECT CAST({CUSTOMER_1} AS BIGINT), CAST(0 AS BIGINT)
  UNION SELECT w.neighbor, r.distance + 1 FROM reach r JOIN walk w ON w.node = r.node AND w.direction = 0 LEFT JOIN recurring.reach k ON k.node = w.neighbor WHERE k.node IS NULL)
SELECT n.id AS node, coalesce(distance, {analytics.UNREACHABLE}) AS distance FROM nodes n LEFT JOIN reach ON reach.node = n.id""")
def g01(g):
    return analytics.with_sentinel(analytics.bfs(g, CUSTOMER_1))


@registered("g02_wcc", """, c0 AS (SELECT id AS node, id AS c FROM nodes),
""" + ",\n".join(f"c{i + 1} AS (SELECT node, min(c) AS c FROM (SELECT * FROM c{i} UNION ALL SELECT w.neighbor, c FROM c{i} JOIN walk w USING (node)) GROUP BY node)" for i in range(8)) + "\nSELECT node, c AS component FROM c8")
def g02(g):
    return analytics.wcc(g)


def _pagerank_sql(rounds: int = 10) -> str:
    parts = ["od AS (SELECT source, count(*) AS o FROM edges GROUP BY source)", "cnt AS (SELECT count(*) AS k FROM nodes)", "r0 AS (SELECT id AS node, 1.0::DOUBLE / k AS rank FROM nodes CROSS JOIN cnt)"]
    for i in range(rounds):
        parts.append(f"x{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT source FROM od))")
        parts.append(f"g{i} AS (SELECT e.target AS node, sum(r.rank / od.o) AS got FROM edges e JOIN r{i} r ON r.node = e.source JOIN od ON od.source = e.source GROUP BY e.target)")
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id AS node, 0.15::DOUBLE / k + 0.85::DOUBLE * lost / k + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM nodes n CROSS JOIN cnt CROSS JOIN x{i} LEFT JOIN g{i} ON g{i}.node = n.id)")
    return ", " + ",\n".join(parts) + f"\nSELECT node, round(rank, 9) AS rank FROM r{rounds}"


@registered("g03_pagerank", _pagerank_sql())
def g03(g):
    return analytics.pagerank(g).withColumn("rank", F.round("rank", 9))


# --- X and E: exploration and embedding -----------------------------------------------------------

_SCORE = lambda t, w: f"CASE WHEN {t} = 'nation_7' THEN {w} * (1.4 + 1) WHEN contains({t}, 'nation_7') THEN {w} * (0.9 + 1) ELSE 0 END"


@registered("x01_lexical", f"""{PROPS_SQL}, labels AS (SELECT 0 AS kind, id, label FROM nodes UNION ALL SELECT 1, id, label FROM edges),
sc AS (SELECT kind, id, {_SCORE("lower(label)", 1.2)} AS s FROM labels UNION ALL SELECT 0, id, CASE key WHEN 'name' THEN {_SCORE("lower(s)", 1.5)} ELSE {_SCORE("lower(s)", 0.55)} END FROM texts)
SELECT CAST(kind AS TINYINT) AS kind, id, round(sum(s), 6) AS score FROM sc GROUP BY kind, id HAVING sum(s) > 0 ORDER BY score DESC, kind, id LIMIT 20""")
def x01(g):
    return _rounded(explore.lexical_search(g, "NATION_7", 20), "score")


@registered("x03_titles", f"""{PROPS_SQL} SELECT CAST(0 AS TINYINT) AS kind, n.id, n.label, coalesce(t.s, n.label || ' ' || n.id) AS title FROM nodes n LEFT JOIN texts t ON t.id = n.id AND t.key = 'name'""")
def x03(g):
    return explore.titled(g, g.elements_of(NODES).select("kind", "id"), NODES).select("kind", "id", "label", "title")


@registered("x05_snapshot")
def x05(g):
    return explore.snapshot(g, 2_000, 3_000).nodes


@registered("x05_whole_snapshot", "SELECT n.id, n.label, count(x.id) AS degree FROM nodes n LEFT JOIN (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) x ON x.id = n.id GROUP BY n.id, n.label")
def x05w(g):
    return explore.snapshot(g, 1 << 30, 1 << 30).nodes


@registered("x06_label_counts", "SELECT label, count(*) AS n FROM nodes GROUP BY label ORDER BY n DESC, label")
def x06(g):
    return filters.label_counts(g)


@registered("x06_relationship_counts", "SELECT label, count(*) AS n FROM edges GROUP BY label ORDER BY n DESC, label")
def x06r(g):
    return filters.relationship_counts(g)


@registered("x07_focus")
def x07(g):
    f = explore.focus(explore.snapshot(g, 2_000, 3_000), node=NATION_7, depth=2, edge_budget=24)
    layers = f.layers if f is not None else []  # no rows where the snapshot does not hold the node
    return g.spark.createDataFrame([(n, depth, f.parents.get(n)) for depth, layer in enumerate(layers) for n in layer], "node bigint, layer int, parent bigint")


@registered("x08_including_path")
def x08(g):
    p = traverse.shortest_path(g, CUSTOMER_1, PART_3)
    return explore.including_path(explore.snapshot(g, 500, 700), g, p.nodes, p.edges).nodes


def queries() -> dict[str, Query]:
    from quiverspark import queries_plans, queries_store  # noqa: F401, they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
