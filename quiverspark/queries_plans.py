"""Registered queries of planners, argument checks, the sketch and the hash embedder, with SQL that works
them out from the raw tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverspark.functions import embedding
from quiverspark.graph import Graph
from quiverspark.model import BOTH, BOTH_KINDS, EDGE, EDGES, IN, NODE, NODES, OUT
from quiverspark.operators import analytics, explore, filters, pattern, sketch, traverse, vectors
from quiverspark.operators.filters import ElementFilter, Range
from quiverspark.operators.pattern import OneHop
from quiverspark.plans import planner
from quiverspark.queries import CUSTOMER_1, NATION_7, ORDER_5, PART_3, PROPS_SQL, QUERY_VECTORS, _late, _late_queries, _rounded, _vector
from quiverspark.queries_store import outcomes, outcomes_sql
from quiverspark.registry import registered

# --- plans of predicates ----------------------------------------------------------------------

FILTERS = {
    "one_value": (ElementFilter("Part", (("size", 10),)), NODES),
    "two_values": (ElementFilter("Part", (("size", 10), ("brand", "Brand#1"))), NODES),
    "types_differ": (ElementFilter("Part", (("size", 10.0),)), NODES),
    "label": (ElementFilter("Supplier"), NODES),
    "label_of_edges": (ElementFilter("CONTAINS"), EDGES),
    "everything": (ElementFilter(), BOTH_KINDS),
}


@registered("p03_element_filter_plan", """, c AS (SELECT (SELECT count(*) FROM part) AS parts, count_if(p_size = 10) AS tens, count_if(p_brand = 'Brand#1') AS brand FROM part),
w(filter, label_bound, p0, p1) AS (
  SELECT 'one_value', parts, tens, NULL FROM c UNION ALL SELECT 'two_values', parts, tens, brand FROM c UNION ALL SELECT 'types_differ', parts, 0, NULL FROM c
  UNION ALL SELECT 'label', count(*), NULL, NULL FROM supplier UNION ALL SELECT 'label_of_edges', count(*), NULL, NULL FROM edges WHERE label = 'CONTAINS'
  UNION ALL SELECT 'everything', NULL, NULL, NULL),
b AS (SELECT *, CASE WHEN p1 IS NOT NULL AND p1 < p0 THEN p1 ELSE p0 END AS best, CASE WHEN p1 IS NOT NULL AND p1 < p0 THEN 1 ELSE 0 END AS place FROM w)
SELECT filter, CASE WHEN best < label_bound THEN 'property_posting' WHEN label_bound IS NOT NULL THEN 'label_posting' ELSE 'full_scan' END AS strategy,
  CAST(CASE WHEN best < label_bound THEN best WHEN label_bound IS NOT NULL THEN label_bound ELSE (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) END AS BIGINT) AS bound,
  CASE WHEN best < label_bound THEN place END AS predicate FROM b""")
def p03(g):
    plans = [(name, filters.element_filter_plan(g, f, target)) for name, (f, target) in FILTERS.items()]
    return g.spark.createDataFrame([(n, p.strategy, p.upper_bound, p.predicate) for n, p in plans], "filter string, strategy string, bound bigint, predicate int")


RANGES = {"both_kinds": (Range("price", 1000.0, 1500.0), BOTH_KINDS), "all_of_a_label": (Range("price", 0.0, label="Part"), BOTH_KINDS), "some_nodes": (Range("size", 5, 10, "Part"), NODES), "nothing": (Range("size", 1000), NODES)}


@registered("p05_numeric_range_plan", """, c AS (SELECT (SELECT count(*) FROM part) AS parts, (SELECT count_if(p_retailprice BETWEEN 1000 AND 1500) FROM part) + (SELECT count_if(l_extendedprice BETWEEN 1000 AND 1500) FROM lineitem) AS few,
  (SELECT count_if(p_retailprice >= 0) FROM part) + (SELECT count_if(l_extendedprice >= 0) FROM lineitem) AS every, (SELECT count_if(p_size BETWEEN 5 AND 10) FROM part) AS sizes),
w(filter, label_bound, n) AS (SELECT 'both_kinds', NULL, few FROM c UNION ALL SELECT 'all_of_a_label', parts, every FROM c UNION ALL SELECT 'some_nodes', parts, sizes FROM c UNION ALL SELECT 'nothing', NULL, 0 FROM c)
SELECT filter, CASE WHEN label_bound IS NULL OR n < label_bound THEN 'numeric_posting' ELSE 'label_posting' END AS strategy, CAST(CASE WHEN label_bound IS NULL OR n < label_bound THEN n ELSE label_bound END AS BIGINT) AS bound FROM w""")
def p05(g):
    plans = [(name, filters.numeric_range_plan(g, r, target)) for name, (r, target) in RANGES.items()]
    return g.spark.createDataFrame([(n, p.strategy, p.upper_bound) for n, p in plans], "filter string, strategy string, bound bigint")


@registered("p06_range_validation", outcomes_sql(no_bound="InvalidArgument", not_a_number="InvalidArgument", mixed_types="InvalidArgument", upside_down="ok", open_end="ok"))
def p06(g):
    return outcomes(g.spark, {"no_bound": lambda: Range("x"), "not_a_number": lambda: Range("x", float("nan")), "mixed_types": lambda: Range("x", 1, 2.0), "upside_down": lambda: Range("x", 2, 1), "open_end": lambda: Range("x", None, 1.5)})


# --- plans of searches --------------------------------------------------------------------------

_EXACT = "CASE WHEN v * 64 <= 67108864 THEN 'exact' ELSE CASE WHEN least(v, {budget}) < v THEN 'sketch' ELSE 'exact' END END"


@registered("v06_vector_search_plan", """, c(search, v) AS (SELECT 'nodes', count_if(kind = 0) FROM owners UNION ALL SELECT 'edges', count_if(kind = 1) FROM owners UNION ALL SELECT 'both', count(*) FROM owners),
p AS (SELECT search, v, CASE WHEN v * 64 <= 67108864 THEN v ELSE greatest(20000, least(50000, v // 50)) END AS b FROM c)
SELECT search, CASE WHEN b < v THEN 'sketch' ELSE 'exact' END AS strategy, v AS vectors, least(v, b) AS budget FROM p""")
def v06(g):
    plans = [(n, planner.vector_search_plan(g, t)) for n, t in (("nodes", NODES), ("edges", EDGES), ("both", BOTH_KINDS))]
    return g.spark.createDataFrame([(n, p.strategy, p.vectors, p.budget) for n, p in plans], "search string, strategy string, vectors bigint, budget bigint")


SETS = [(10, 0), (1_000, 5_000), (0, 2_000_000), (3_000_000, 0), (100_000, 900_000)]


@registered("v07_within_plan", """, sizes(nodes, edges) AS (VALUES """ + ", ".join(f"({a}, {b})" for a, b in SETS) + """),
a AS (SELECT ceil((SELECT count(*) FROM owners WHERE kind = 0) / (SELECT count(*) FROM nodes)) AS n, ceil((SELECT count(*) FROM owners WHERE kind = 1) / (SELECT count(*) FROM edges)) AS e),
c AS (SELECT s.nodes, s.edges, CAST(s.nodes * a.n + s.edges * a.e AS BIGINT) AS v FROM sizes s CROSS JOIN a),
p AS (SELECT nodes, edges, v, CASE WHEN v * 64 <= 33554432 THEN v ELSE least(v, greatest(5000, least(20000, v // 4))) END AS b FROM c)
SELECT CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges, CASE WHEN b < v THEN 'sketch' ELSE 'exact' END AS strategy, v AS vectors, b AS budget FROM p""")
def v07(g):
    plans = [(a, b, planner.vector_search_within_plan(g, a, b)) for a, b in SETS]
    return g.spark.createDataFrame([(a, b, p.strategy, p.vectors, p.budget) for a, b, p in plans], "nodes bigint, edges bigint, strategy string, vectors bigint, budget bigint")


@registered("v13_argument_errors", outcomes_sql(fine="ok", zero_query="InvalidArgument", wrong_length="InvalidArgument", not_finite="InvalidArgument", negative_k="InvalidArgument", no_budget="InvalidArgument", no_queries="InvalidArgument", wrong_weights="InvalidArgument", negative_weight="InvalidArgument", zero_weights="InvalidArgument"))
def v13(g):
    q = _vector(g, 7)
    return outcomes(g.spark, {
        "fine": lambda: vectors.vector_search(g, q, 1),
        "zero_query": lambda: vectors.vector_search(g, [0.0] * g.dimension, 1),
        "wrong_length": lambda: vectors.vector_search(g, [1.0], 1),
        "not_finite": lambda: vectors.vector_search(g, [float("inf")] * g.dimension, 1),
        "negative_k": lambda: vectors.vector_search(g, q, -1),
        "no_budget": lambda: sketch.vector_search_approximate(g, q, 1, 0),
        "no_queries": lambda: vectors.late_interaction_search(g, [], 1),
        "wrong_weights": lambda: vectors.late_interaction_search(g, [q], 1, [1.0, 2.0]),
        "negative_weight": lambda: vectors.late_interaction_search(g, [q], 1, [-1.0]),
        "zero_weights": lambda: vectors.late_interaction_search(g, [q], 1, [0.0]),
    })


HOPS = {
    "one_customer": OneHop(ElementFilter("Customer", (("name", "Customer#000000001"),)), "PLACED"),
    "few_ends": OneHop(ElementFilter("Supplier"), "BASED_IN", ElementFilter("Region")),
    "all_edges": OneHop(ElementFilter("Order"), "IN_REGION"),
    "undirected": OneHop(ElementFilter("Region"), None, ElementFilter(), BOTH),
}


@registered("t10_one_hop_plan", """, d AS (SELECT ceil((SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes)) AS degree, (SELECT count(*) FROM nodes) AS n),
one AS (SELECT count(*) AS k FROM customer WHERE c_name = 'Customer#000000001'),
w(pattern, e, s, t, f) AS (
  SELECT 'one_customer', (SELECT count(*) FROM edges WHERE label = 'PLACED'), least((SELECT k FROM one), (SELECT count(*) FROM customer)), n, 1 FROM d
  UNION ALL SELECT 'few_ends', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier), (SELECT count(*) FROM region), 1 FROM d
  UNION ALL SELECT 'all_edges', (SELECT count(*) FROM nation), (SELECT count(*) FROM orders), n, 1 FROM d
  UNION ALL SELECT 'undirected', (SELECT count(*) FROM edges), (SELECT count(*) FROM region), n, 2 FROM d),
c AS (SELECT pattern, e, s, t, CAST(s * degree * f AS BIGINT) AS a, CAST(t * degree * f AS BIGINT) AS z FROM w CROSS JOIN d)
SELECT pattern, CASE WHEN e <= a AND e <= z THEN 'edge_scan' WHEN a <= z THEN 'start_adjacency' ELSE 'end_adjacency' END AS strategy, least(e, a, z) AS visits, e AS edge_bound, s AS start_bound, t AS end_bound FROM c""")
def t10(g):
    plans = [(n, pattern.plan(g, q)) for n, q in HOPS.items()]
    return g.spark.createDataFrame([(n, p.strategy, p.estimated_visits, p.edge_bound, p.start_bound, p.end_bound) for n, p in plans], "pattern string, strategy string, visits bigint, edge_bound bigint, start_bound bigint, end_bound bigint")


@registered("t10_ways_agree", "SELECT way, source AS start, id AS edge, target AS \"end\" FROM edges CROSS JOIN (VALUES ('edge_scan'), ('start_adjacency'), ('end_adjacency')) AS w(way) WHERE label = 'PLACED' AND source IN (SELECT c_custkey * 8 + 2 FROM customer WHERE c_mktsegment = 'BUILDING')")
def t10w(g):
    out, query = None, OneHop(ElementFilter("Customer", (("segment", "BUILDING"),)), "PLACED", ElementFilter("Order"))
    for way in ("edge_scan", "start_adjacency", "end_adjacency"):
        found = pattern.matches(g, query, planner.OneHopPlan(way, 0, 0, 0, 0)).select(F.lit(way).alias("way"), "start", "edge", "end")
        out = found if out is None else out.unionByName(found)
    return out


QUERIES_TEXT = [
    ("MATCH (c:Customer)-[r:PLACED]->(o:Order) RETURN c, r LIMIT 7;", "Customer", "PLACED", "Order", OUT, 7),
    ("match (a)<-[e]-(b) return *", None, None, None, IN, 100),
    ("MATCH (a)-[e:X]-(b:B) RETURN a", None, "X", "B", BOTH, 100),
    ("  Match ( a : A ) - [ e ] -> ( b ) Return b  Limit 0 ", "A", None, None, OUT, 0),
]


def _or_null(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


@registered("q01_parser", "SELECT * FROM (VALUES " + ", ".join(f"({_or_null(t)}, {_or_null(a)}, {_or_null(e)}, {_or_null(b)}, '{d}', {n})" for t, a, e, b, d, n in QUERIES_TEXT) + ") AS t(text, start_label, edge_label, end_label, direction, n)")
def q01(g):
    rows = [(t, q.start.label, q.edge_label, q.end.label, q.direction, q.limit) for t, *_ in QUERIES_TEXT for q in [pattern.parse(t)]]
    return g.spark.createDataFrame(rows, "text string, start_label string, edge_label string, end_label string, direction string, n int")


@registered("q01_parser_errors", outcomes_sql(both_ways="InvalidArgument", no_return="InvalidArgument", no_name="InvalidArgument", two_hops="InvalidArgument"))
def q01e(g):
    texts = {"both_ways": "MATCH (a)<-[e]->(b) RETURN a", "no_return": "MATCH (a)-[e]->(b)", "no_name": "MATCH ()-[e]->(b) RETURN b", "two_hops": "MATCH (a)-[e]->(b)-[f]->(c) RETURN a"}
    return outcomes(g.spark, {n: lambda t=t: pattern.parse(t) for n, t in texts.items()})


# --- paths ----------------------------------------------------------------------------------------

PAIRS = [(CUSTOMER_1, PART_3), (ORDER_5, NATION_7), (NATION_7, PART_3), (PART_3, CUSTOMER_1)]


def _layers_sql(name: str, column: str, hops: int) -> str:
    """Distances from one end of every pair, layer by layer."""
    parts = [f"{name}0 AS (SELECT a, b, {column} AS node, 0 AS d FROM pairs)"]
    for k in range(hops):
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT a, b, node, min(d) AS d FROM (SELECT * FROM {name}{k} UNION ALL SELECT a, b, neighbor, d + 1 FROM {name}{k} JOIN walk USING (node) WHERE d = {k}) GROUP BY a, b, node)")
    return ",\n".join(parts)


#: All shortest paths of up to four hops; of them the smallest sequence of nodes, then of edges.
SHORTEST = """, pairs(a, b) AS (VALUES """ + ", ".join(f"({a}, {b})" for a, b in PAIRS) + """),
""" + _layers_sql("f", "a", 2) + ",\n" + _layers_sql("t", "b", 2) + """,
len AS (SELECT a, b, min(f2.d + t2.d) AS d FROM f2 JOIN t2 USING (a, b, node) GROUP BY a, b),
on_path AS (SELECT a, b, node, f2.d AS pos FROM f2 JOIN t2 USING (a, b, node) JOIN len USING (a, b) WHERE f2.d + t2.d = len.d
  UNION SELECT a, b, node, f2.d FROM f2 JOIN len USING (a, b) WHERE f2.d <= len.d - 2 UNION SELECT a, b, node, len.d - t2.d FROM t2 JOIN len USING (a, b) WHERE t2.d <= len.d - 2),
paths(a, b, pos, nodes, edges) AS (
  SELECT a, b, 0, [CAST(a AS BIGINT)], CAST([] AS BIGINT[]) FROM pairs
  UNION ALL SELECT p.a, p.b, p.pos + 1, list_append(p.nodes, w.neighbor), list_append(p.edges, w.edge) FROM paths p JOIN walk w ON w.node = p.nodes[-1] JOIN on_path o ON o.a = p.a AND o.b = p.b AND o.node = w.neighbor AND o.pos = p.pos + 1),
best AS (SELECT a, b, nodes, edges FROM paths WHERE nodes[-1] = b QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY nodes, edges) = 1)
"""


@registered("t07_bidirectional_path", SHORTEST + "SELECT CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS \"end\", 'found' AS termination, 'bidirectional_breadth_first' AS strategy, nodes, edges FROM best")
def t07(g):
    rows = [(a, b, p.termination, p.strategy, p.nodes, p.edges) for a, b in PAIRS for p in [traverse.shortest_path(g, a, b, max_hops=4)]]
    return g.spark.createDataFrame(rows, "start bigint, end bigint, termination string, strategy string, nodes array<bigint>, edges array<bigint>")


@registered("t08_best_meeting", SHORTEST + "SELECT CAST(a AS BIGINT) AS start, CAST(len(edges) AS INTEGER) AS hops, nodes FROM best WHERE b = " + str(PART_3))
def t08(g):
    rows = []
    for a, b in PAIRS:
        if b == PART_3:
            ahead, behind = traverse._Side(g, a, BOTH, None), traverse._Side(g, b, BOTH, None)
            for side in (ahead, behind, ahead, behind):
                side.advance(1 << 30)
                met = ahead.reached.join(behind.reached.select("id", F.col("depth").alias("far")), "id").agg(F.min(F.col("depth") + F.col("far"))).first()[0]
                if met is not None and met <= ahead.depth + behind.depth:
                    break
            nodes, edges = traverse._meeting(ahead, behind, met)
            rows.append((a, len(edges), nodes))
    return g.spark.createDataFrame(rows, "start bigint, hops int, nodes array<bigint>")


@registered("x04_evidence", SHORTEST + f""", steps AS (SELECT unnest(range(len(nodes))) AS position, nodes, edges FROM best WHERE a = {CUSTOMER_1} AND b = {PART_3}),
s AS (SELECT position, nodes[position + 1] AS id, CASE WHEN position > 0 THEN edges[position] END AS edge FROM steps)
SELECT CAST(s.position AS INTEGER) AS position, s.id, n.label AS node_label, s.edge, e.label AS edge_label, e.target = s.id AS forward FROM s JOIN nodes n ON n.id = s.id LEFT JOIN edges e ON e.id = s.edge""")
def x04(g):
    return traverse.evidence_path(g, CUSTOMER_1, PART_3)[1].drop("node_props")


@registered("x09_orbit", "SELECT id, round(cos(2 * pi() * (row_number() OVER (ORDER BY id) - 1) / (SELECT count(*) FROM nodes)), 6) AS x, round(sin(2 * pi() * (row_number() OVER (ORDER BY id) - 1) / (SELECT count(*) FROM nodes)), 6) AS y FROM nodes")
def x09(g):
    return _rounded(explore.orbit(explore.snapshot(g, 1 << 30, 1 << 30)), "x", "y")


@registered("g04_mismatches", f""", reach(node, distance) USING KEY (node) AS (
  SELECT CAST({CUSTOMER_1} AS BIGINT), CAST(0 AS BIGINT)
  UNION SELECT w.neighbor, r.distance + 1 FROM reach r JOIN walk w ON w.node = r.node AND w.direction = 0 LEFT JOIN recurring.reach k ON k.node = w.neighbor WHERE k.node IS NULL)
SELECT node, distance + 2 AS wanted, distance AS got FROM reach WHERE node % 97 = 0""")
def g04(g):
    """A reference file that is off by two where 97 divides a node, and off by one, which is allowed, elsewhere."""
    found = analytics.bfs(g, CUSTOMER_1).where("distance IS NOT NULL")
    truth = found.select("node", (F.col("distance") + F.when(F.col("node") % 97 == 0, 2).otherwise(1)).alias("distance"))
    return analytics.mismatches(found, truth, "distance", absolute=1.0).select("node", "wanted", "got")


# --- the sketch -----------------------------------------------------------------------------------

WIDTHS = [1, 2, 3, 4, 5, 63, 64, 65, 100, 127, 128, 129, 200, 512, 513, 768, 1024, 1536]


@registered("k01_width", "SELECT d AS dimension, CASE WHEN d >= 128 THEN greatest(512, n) ELSE n END AS width, CAST(ceil(least(512, CASE WHEN d >= 128 THEN greatest(512, n) ELSE n END) / 64) AS INTEGER) AS words FROM (SELECT d, CAST(2 ** ceil(log2(d)) AS INTEGER) AS n FROM (VALUES " + ", ".join(f"({d})" for d in WIDTHS) + ") AS t(d))")
def k01(g):
    return g.spark.createDataFrame([(d, sketch.width(d), sketch.words(d)) for d in WIDTHS], "dimension int, width int, words int")


_TOP = "18446744073709551616"


def _mixed(x: str, shift: int, factor: int) -> str:
    return f"CAST((CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * {factor}) % {_TOP} AS UBIGINT)"


#: Signs of both rounds, and every embedding's transform: a sum over i of x[i] * sign[i] * (-1) ** bits(i & k), twice.
SIGNS = f""", idx AS (SELECT unnest(range(64)) AS i), seeds(turn, seed) AS (VALUES (0, {sketch.SEEDS[0]}::UBIGINT), (1, {sketch.SEEDS[1]}::UBIGINT)),
m0 AS (SELECT turn, i, CAST((i::UHUGEINT + seed) % {_TOP} AS UBIGINT) AS x FROM idx CROSS JOIN seeds),
m1 AS (SELECT turn, i, {_mixed('x', 30, 0xBF58476D1CE4E5B9)} AS x FROM m0), m2 AS (SELECT turn, i, {_mixed('x', 27, 0x94D049BB133111EB)} AS x FROM m1),
sg AS MATERIALIZED (SELECT turn, i, CASE WHEN xor(x, x >> 31) % 2 = 1 THEN -1 ELSE 1 END AS s FROM m2)
"""
PROJECTED = SIGNS + """, had AS MATERIALIZED (SELECT a.i, b.i AS k, CASE WHEN bit_count(a.i & b.i) % 2 = 1 THEN -1 ELSE 1 END AS h FROM idx a CROSS JOIN idx b),
x0 AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS i FROM embeddings),
y1 AS MATERIALIZED (SELECT vec_id, k AS i, sum(x * s * h) AS x FROM x0 JOIN sg USING (i) JOIN had USING (i) WHERE turn = 0 GROUP BY vec_id, k),
y2 AS MATERIALIZED (SELECT vec_id, k AS i, sum(x * s * h) AS x FROM y1 JOIN sg USING (i) JOIN had USING (i) WHERE turn = 1 GROUP BY vec_id, k),
mean AS (SELECT vec_id, avg(abs(x)) AS m FROM y2 GROUP BY vec_id),
sig AS MATERIALIZED (SELECT vec_id, CAST(sum(CASE WHEN x >= 0 THEN 1::HUGEINT << CAST(i AS HUGEINT) ELSE 0 END) AS UBIGINT) AS w, CAST(sum(CASE WHEN abs(x) >= m THEN 1::HUGEINT << CAST(i AS HUGEINT) ELSE 0 END) AS UBIGINT) AS mask FROM y2 JOIN mean USING (vec_id) GROUP BY vec_id)
"""


@registered("k03_signs", SIGNS + "SELECT CAST(turn AS INTEGER) AS turn, CAST(i AS INTEGER) AS place, CAST(s AS INTEGER) AS sign FROM sg")
def k03(g):
    rows = [(turn, i, int(s)) for turn, seed in enumerate(sketch.SEEDS) for i, s in enumerate(sketch.signs(64, seed))]
    return g.spark.createDataFrame(rows, "turn int, place int, sign int")


@registered("k02_signatures", PROJECTED + "SELECT CAST(kind AS TINYINT) AS kind, id, CAST(facet AS INTEGER) AS facet, hex(w) AS word FROM owners JOIN sig USING (vec_id)")
def k02(g):
    return g.sketch.select("kind", "id", "facet", F.hex(F.col("sig")[0]).alias("word"))


_DISTANCE = "bit_count(xor(sig.w, q.w))"


@registered("k04_hamming", PROJECTED + f"SELECT CAST(kind AS TINYINT) AS kind, id, CAST(facet AS INTEGER) AS facet, CAST({_DISTANCE} AS INTEGER) AS distance FROM owners JOIN sig USING (vec_id) CROSS JOIN (SELECT * FROM sig WHERE vec_id = 7) q")
def k04(g):
    q = sketch.signatures(np.asarray([_vector(g, 7)], dtype=np.float32))[0]
    return g.sketch.select("kind", "id", "facet", sketch.hamming(F.col("sig"), q).alias("distance"))


@registered("k05_confident_hamming", PROJECTED + f"SELECT CAST(kind AS TINYINT) AS kind, id, CAST(facet AS INTEGER) AS facet, CAST({_DISTANCE} + bit_count(xor(sig.w, q.w) & q.mask) AS INTEGER) AS distance FROM owners JOIN sig USING (vec_id) CROSS JOIN (SELECT * FROM sig WHERE vec_id = 7) q")
def k05(g):
    x = np.asarray([_vector(g, 7)], dtype=np.float32)
    return g.sketch.select("kind", "id", "facet", sketch.hamming(F.col("sig"), sketch.signatures(x)[0], sketch.confidence_masks(x)[0]).alias("distance"))


@registered("k06_when_confident", "SELECT * FROM (VALUES ('everything', (SELECT count(*) = count(DISTINCT (kind, id)) FROM owners)), ('a_label', FALSE), ('a_set', FALSE), ('nodes_alone', FALSE)) AS t(search, confident)")
def k06(g):
    part = filters.element_set(g, [PART_3])
    told = {"everything": sketch.confident(g, BOTH_KINDS, None, None), "a_label": sketch.confident(g, BOTH_KINDS, "Part", None), "a_set": sketch.confident(g, BOTH_KINDS, None, part), "nodes_alone": sketch.confident(g, NODES, None, None)}
    return g.spark.createDataFrame(list(told.items()), "search string, confident boolean")


def _shortlist_sql(name: str, budget: int, where: str = "TRUE", vec_id: int = 7) -> str:
    return f""", {name} AS (SELECT kind, id FROM (SELECT kind, id, min({_DISTANCE}) AS d FROM owners JOIN sig USING (vec_id) CROSS JOIN (SELECT * FROM sig WHERE vec_id = {vec_id}) q WHERE {where} GROUP BY kind, id) ORDER BY d, kind, id LIMIT {budget})"""


@registered("k07_shortlist", PROJECTED + _shortlist_sql("near", 100, "kind = 0") + " SELECT CAST(kind AS TINYINT) AS kind, id FROM near")
def k07(g):
    return sketch.shortlist(g, vectors.prepared_query(g, _vector(g, 7)), 100, NODES, None, None)


_SMALL = "kind = 0 AND id IN (SELECT p_partkey * 8 + 4 FROM part WHERE p_size <= 25)"


@registered("k08_prefilter", f"SELECT 'label' AS prefilter, CAST(kind AS TINYINT) AS kind, id, CAST(facet AS INTEGER) AS facet FROM owners WHERE label = 'Supplier' UNION ALL SELECT 'set', kind, id, facet FROM owners WHERE {_SMALL}")
def k08(g):
    by_label = sketch._eligible(g, BOTH_KINDS, "Supplier", None)
    by_set = sketch._eligible(g, BOTH_KINDS, None, filters.elements_in_range(g, Range("size", None, 25)))
    return by_label.select(F.lit("label").alias("prefilter"), "kind", "id", "facet").unionByName(by_set.select(F.lit("set").alias("prefilter"), "kind", "id", "facet"))


def _reranked_sql(near: str, k: int = 10) -> str:
    return f""", q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7),
s AS (SELECT kind, id, facet, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9) AS score FROM owners JOIN embeddings USING (vec_id) JOIN {near} USING (kind, id) CROSS JOIN q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY score DESC, facet) = 1),
t AS (SELECT * FROM b ORDER BY score DESC, kind DESC, id DESC LIMIT {k})
SELECT CAST(kind AS TINYINT) AS kind, id, CAST(facet AS INTEGER) AS facet, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, kind, id) AS INTEGER) AS rank FROM t"""


@registered("v03_vector_search_approximate", PROJECTED + _shortlist_sql("near", 200, "kind = 0") + _reranked_sql("near"))
def v03(g):
    return _rounded(sketch.vector_search_approximate(g, _vector(g, 7), 10, 200, NODES), "score")


@registered("v04_within_approximate", PROJECTED + _shortlist_sql("near", 100, _SMALL) + _reranked_sql("near"))
def v04(g):
    return _rounded(sketch.vector_search_approximate(g, _vector(g, 7), 10, 100, NODES, within=filters.elements_in_range(g, Range("size", None, 25))), "score")


@registered("v11_late_interaction_approximate", PROJECTED + f""", qs AS (SELECT vec_id AS i, CASE vec_id WHEN 7 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS share, w FROM sig WHERE vec_id IN {QUERY_VECTORS}),
m AS (SELECT i, share, kind, id, min(bit_count(xor(sig.w, qs.w))) AS d FROM owners JOIN sig USING (vec_id) CROSS JOIN qs WHERE kind = 0 GROUP BY i, share, kind, id),
near AS (SELECT kind, id FROM (SELECT kind, id, sum(CAST(round(d * share * {sketch.WEIGHT_SCALE}) AS BIGINT)) AS d FROM m GROUP BY kind, id) ORDER BY d, kind, id LIMIT 200),
q AS (SELECT vec_id AS i, CASE vec_id WHEN 7 THEN 0.75 ELSE 0.25 END AS share, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN {QUERY_VECTORS}),
s AS (SELECT i, share, kind, id, facet, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9) AS score FROM owners JOIN embeddings USING (vec_id) JOIN near USING (kind, id) CROSS JOIN q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY i, kind, id ORDER BY score DESC, facet) = 1),
e AS (SELECT kind, id, round(sum(score * share), 9) AS score, max(CASE i WHEN 7 THEN facet END) AS facet_0, max(CASE i WHEN 42 THEN facet END) AS facet_1 FROM b GROUP BY kind, id),
t AS (SELECT * FROM e ORDER BY score DESC, kind DESC, id DESC LIMIT 10)
SELECT CAST(kind AS TINYINT) AS kind, id, round(score, 6) AS score, CAST(facet_0 AS INTEGER) AS facet_0, CAST(facet_1 AS INTEGER) AS facet_1, CAST(row_number() OVER (ORDER BY score DESC, kind, id) AS INTEGER) AS rank FROM t""")
def v11(g):
    return _late(sketch.late_interaction_search_approximate(g, _late_queries(g), 10, 200, [3, 1], NODES))


@registered("v14_recall", PROJECTED + """, qv AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v, w AS qw FROM embeddings JOIN sig USING (vec_id) WHERE vec_id % 20 = 0),
s AS MATERIALIZED (SELECT query, kind, id, max(round(list_inner_product(CAST(embedding AS DOUBLE[]), v), 9)) AS score, min(bit_count(xor(w, qw))) AS d FROM owners JOIN embeddings USING (vec_id) JOIN sig USING (vec_id) CROSS JOIN qv WHERE kind = 0 GROUP BY query, kind, id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, kind DESC, id DESC) <= 10 AS wanted, row_number() OVER (PARTITION BY query ORDER BY d, kind, id) <= 300 AS near FROM s),
hits AS (SELECT *, row_number() OVER (PARTITION BY query, near ORDER BY score DESC, kind DESC, id DESC) <= 10 AND near AS found FROM r)
SELECT CAST(query AS BIGINT) AS query, count_if(wanted AND found) / 10 AS recall FROM hits GROUP BY query""")
def v14(g):
    """Every twentieth vector is asked: the exact searches in one job, the shortlists in another.

    An approximate search reranks its shortlist exactly, so one of the true ten is found if, and only if, the
    shortlist has it: whatever is ahead of it there is ahead of it among all elements, too.
    """
    asked = g.vectors_of(NODES, "Nation").select((F.col("facet") * 25 + F.floor(F.col("id") / 8)).alias("query"), "vec").where("query % 20 = 0").orderBy("query").collect()
    queries = [[float(x) for x in r["vec"]] for r in asked]
    truth = vectors.vector_search_many(g, queries, 10, NODES)
    near = sketch.shortlist_many(g, queries, 300, NODES)
    hits = truth.select("query", "kind", "id").join(near, ["query", "kind", "id"], "left_semi").groupBy("query").agg(F.count("*").alias("n"))
    names = g.spark.createDataFrame([(i, r["query"]) for i, r in enumerate(asked)], "place int, query bigint")
    return names.join(hits.withColumnRenamed("query", "place"), "place", "left").select("query", (F.coalesce("n", F.lit(0)) / 10).alias("recall"))


# --- the hash embedder ------------------------------------------------------------------------------


def _embedded_sql(texts: str) -> str:
    """(id, v): hash embeddings of 64 components of the ASCII texts of a table (id, s)."""
    step = f"(CAST(xor(CAST(a AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * {embedding.FNV_PRIME}) % {_TOP}"
    return f""", tk AS (SELECT id, unnest(regexp_extract_all(lower(s), '[a-z0-9_]+')) AS w FROM {texts}),
gr AS (SELECT id, w AS t, 1.0::FLOAT AS weight FROM tk UNION ALL SELECT id, substr(w, CAST(k AS INTEGER), 3), 0.2::FLOAT FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM tk)),
ws AS (SELECT id, t, weight, count(*) AS n FROM gr GROUP BY id, t, weight),
hs AS (SELECT t, list_reduce(list_prepend({embedding.FNV_OFFSET}::UHUGEINT, list_transform(string_split(t, ''), lambda c: ord(c)::UHUGEINT)), lambda a, b: {step}) AS h FROM (SELECT DISTINCT t FROM ws)),
cells AS (SELECT id, CAST(h % 64 AS INTEGER) AS k, sum(n * CASE WHEN h >= 9223372036854775808 THEN -weight ELSE weight END) AS x FROM ws JOIN hs USING (t) GROUP BY id, h % 64),
norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM cells GROUP BY id)"""


@registered("e01_hash_embedding", PROPS_SQL + """, named AS (SELECT id, s FROM texts WHERE key = 'name')""" + _embedded_sql("named") + """, first AS (SELECT id, x FROM cells WHERE k = 0), ninth AS (SELECT id, x FROM cells WHERE k = 9)
SELECT id, round(coalesce(first.x, 0) / norm, 4) + 0.0 AS first, round(coalesce(ninth.x, 0) / norm, 4) + 0.0 AS ninth, 1.0::DOUBLE AS norm FROM norms LEFT JOIN first USING (id) LEFT JOIN ninth USING (id)""")
def e01(g):
    """Names of all nodes that have one."""
    named = g.nodes.where(F.col("props")["name"].isNotNull()).select("id", embedding.hash_embed(F.col("props")["name"]["s"], 64).alias("v"))
    part = lambda k: (F.round(F.col("v")[k].cast("double"), 4) + 0.0)
    return named.select("id", part(0).alias("first"), part(9).alias("ninth"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


@registered("e03_embedding_cache", ", named AS (SELECT o_orderkey * 8 + 5 AS id, o_orderpriority AS s FROM orders), once AS (SELECT min(id) AS id, s FROM named GROUP BY s)" + _embedded_sql("once") + """
SELECT named.id, named.s AS priority, round(coalesce(x, 0) / norm, 4) + 0.0 AS first FROM named JOIN once USING (s) JOIN norms ON norms.id = once.id LEFT JOIN (SELECT id, x FROM cells WHERE k = 9) c ON c.id = once.id""")
def e03(g):
    rows = g.nodes.where("label = 'Order'").select("id", F.col("props")["priority"]["s"].alias("priority"))
    return embedding.embed_unique(rows, "priority", None, 64).select("id", "priority", (F.round(F.col("embedding")[9].cast("double"), 4) + 0.0).alias("first"))


def _asked_sql(words: str) -> str:
    """q(v): the hash embedding of some words, in 32 bits as the embedder gives it."""
    return f", asked AS (SELECT 0 AS id, '{words}' AS s)" + _embedded_sql("asked") + """, q AS (SELECT list(coalesce(CAST(CAST(x AS FLOAT) / CAST(norm AS FLOAT) AS DOUBLE), 0) ORDER BY i) AS v FROM (SELECT unnest(range(64)) AS i) LEFT JOIN cells ON cells.k = i CROSS JOIN norms)"""


_LEXICAL = lambda t, w: f"CASE WHEN {t} = 'nation_7' THEN {w} * (1.4::DOUBLE + 1) WHEN contains({t}, 'nation_7') THEN {w} * (0.9::DOUBLE + 1) ELSE 0 END"


@registered("x02_hybrid", PROPS_SQL + _asked_sql("NATION_7") + f""", named AS (SELECT 0 AS kind, id, label FROM nodes UNION ALL SELECT 1, id, label FROM edges),
sc AS (SELECT kind, id, {_LEXICAL("lower(label)", 1.2)} AS s FROM named UNION ALL SELECT 0, id, CASE key WHEN 'name' THEN {_LEXICAL("lower(s)", 1.5)} ELSE {_LEXICAL("lower(s)", 0.55)} END FROM texts),
lx AS (SELECT kind, id, round(sum(s), 9) AS s FROM sc GROUP BY kind, id HAVING sum(s) > 0 ORDER BY s DESC, kind, id LIMIT 60),
l AS (SELECT kind, id, least(1.0, s / (SELECT max(s) FROM lx)) AS lexical FROM lx),
s AS (SELECT kind, id, facet, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9) AS score FROM owners JOIN embeddings USING (vec_id) CROSS JOIN q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY score DESC, facet) = 1),
m AS (SELECT kind, id, facet, greatest(0.0, least(1.0, (score + 1) / 2)) AS semantic FROM (SELECT * FROM b ORDER BY score DESC, kind DESC, id DESC LIMIT 60)),
h AS (SELECT kind, id, facet, lexical, semantic, round(coalesce(lexical, 0) * 0.46::DOUBLE + coalesce(semantic, 0) * 0.54::DOUBLE, 9) AS score FROM l FULL JOIN m USING (kind, id) ORDER BY score DESC, kind, id LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY score DESC, kind, id) AS INTEGER) AS rank, CAST(kind AS TINYINT) AS kind, id, round(score, 5) AS score, round(lexical, 5) AS lexical, round(semantic, 5) AS semantic, CAST(facet AS INTEGER) AS facet FROM h""")
def x02(g):
    hits = explore.hybrid_search(g, "NATION_7", 10).hits
    for c in ("score", "lexical", "semantic"):
        hits = hits.withColumn(c, F.round(c, 5))
    return hits


@registered("q03_query_text", _asked_sql("a small part") + """,
s AS (SELECT kind, id, max(round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 9)) AS score FROM owners JOIN embeddings USING (vec_id) CROSS JOIN q GROUP BY kind, id),
seeds AS (SELECT s.id, s.score FROM s JOIN nodes USING (id) WHERE kind = 0 AND label = 'Part' ORDER BY score DESC, id DESC LIMIT 80),
m AS (SELECT w.node AS start, w.edge, w.neighbor AS "end", seeds.score AS start_score, e.score AS edge_score, t.score AS end_score FROM walk w JOIN seeds ON w.node = seeds.id JOIN nodes x ON x.id = w.neighbor AND x.label = 'Supplier'
  LEFT JOIN s e ON e.kind = 1 AND e.id = w.edge LEFT JOIN s t ON t.kind = 0 AND t.id = w.neighbor WHERE w.label = 'SUPPLIED_BY' AND w.direction = 0),
r AS (SELECT *, round((start_score * 0.5 + coalesce(edge_score * 0.25, 0) + coalesce(end_score * 0.25, 0)) / (0.5 + CASE WHEN edge_score IS NULL THEN 0 ELSE 0.25 END + CASE WHEN end_score IS NULL THEN 0 ELSE 0.25 END), 9) AS score FROM m)
SELECT start, edge, "end", round(score, 5) AS score, round(start_score, 5) AS start_score, round(edge_score, 5) AS edge_score, round(end_score, 5) AS end_score FROM r ORDER BY r.score DESC, start, edge, "end" LIMIT 10""")
def q03(g):
    found = pattern.query_text(g, "MATCH (p:Part)-[s:SUPPLIED_BY]->(x:Supplier) RETURN p LIMIT 10", embedding.hash_embedding, "a small part")
    for c in ("score", "start_score", "edge_score", "end_score"):
        found = found.withColumn(c, F.round(c, 5))
    return found
