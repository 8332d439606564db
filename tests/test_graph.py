"""Operators on small graphs with exact expectations."""

import numpy as np
import pytest

from quiverspark import model
from quiverspark.functions import embedding
from quiverspark.graph import Graph
from quiverspark.model import EDGE, EDGES, IN, NODE, NODES, OUT, InvalidArgument, NotFound
from quiverspark.operators import analytics, explore, filtered, filters, pattern, semantic, sketch, traverse, vectors
from quiverspark.operators.filters import ElementFilter, Range
from quiverspark.operators.pattern import OneHop
from quiverspark.plans import planner
from tests.conftest import rows

E1, E2, E3, E4 = np.eye(4).tolist()


def make(spark, nodes, edges=(), dimension=4):
    """A graph from (label, props, vectors) and (source, target, label, props, vectors); ids are places."""
    full = lambda x, n: (*x, *({}, ())[len(x) - n :]) if len(x) < n + 2 else x
    nodes, edges = [full(x, 1) for x in nodes], [full(x, 3) for x in edges]
    stored = lambda p: {k: model.value_row(v) for k, v in p.items()}
    n = spark.createDataFrame([(i, x[0], stored(x[1]), 1) for i, x in enumerate(nodes)], model.NODES_DDL)
    e = spark.createDataFrame([(i, x[0], x[1], x[2], stored(x[3]), 1) for i, x in enumerate(edges)], model.EDGES_DDL)
    v = [(NODE, i, f, x[0], vec) for i, x in enumerate(nodes) for f, vec in enumerate(x[2])] + [(EDGE, i, f, x[2], vec) for i, x in enumerate(edges) for f, vec in enumerate(x[4])]
    return Graph(n, e, spark.createDataFrame(v, model.VECTORS_DDL), dimension)


def ids(df, kind=NODE):
    return {r["id"] for r in df.collect() if r["kind"] == kind}


def test_one_hop_planner(spark):
    nodes = [("Seed", {}, [E1]), ("Target", {}, [E2])] + [("Noise",)] * 49
    edges = [(0, 1, "UNIQUE")] + [(2 + i, 3 + i, "NOISE") for i in range(48)]
    g = make(spark, nodes, edges)
    seed = OneHop(start=ElementFilter("Seed"), limit=10)
    assert pattern.plan(g, seed).strategy == "start_adjacency" and pattern.plan(g, seed).start_bound == 1
    assert pattern.plan(g, OneHop(end=ElementFilter("Target"))).strategy == "end_adjacency"
    unique = OneHop(edge_label="UNIQUE")
    assert pattern.plan(g, unique).strategy == "edge_scan" and pattern.plan(g, unique).edge_bound == 1
    for q in (seed, OneHop(end=ElementFilter("Target")), unique):
        assert rows(pattern.match_one_hop(g, q)) == [(0, 0, 1)]
    assert rows(pattern.match_one_hop(g, OneHop(ElementFilter("Target"), None, ElementFilter("Seed"), IN))) == [(1, 0, 0)]


def test_late_interaction(spark):
    g = make(spark, [("Artifact", {}, [E1, E2]), ("Artifact", {}, [E1]), ("Artifact", {}, [E2])])
    hits = vectors.late_interaction_search(g, [E1, E2], 3, target=NODES).orderBy("rank").collect()
    assert (hits[0]["id"], hits[0]["score"], hits[0]["facets"]) == (0, 1.0, [0, 1]) and hits[1]["score"] == 0.5
    weighted = vectors.late_interaction_search(g, [E1, E2], 3, [1.0, 0.0], NODES).orderBy("rank").collect()
    assert weighted[0]["score"] == 1.0 and 1 in {h["id"] for h in weighted}
    within = vectors.late_interaction_search(g, [E1, E2], 3, within=filters.element_set(g, [1])).collect()
    assert [(h["id"], h["score"]) for h in within] == [(1, 0.5)]
    near = sketch.late_interaction_search_approximate(g, [E1, E2], 1, 2, target=NODES).collect()
    assert near[0]["id"] == 0
    for bad in (([], None), ([E1], [1.0, 2.0]), ([E1], [-1.0]), ([E1], [0.0]), ([E1], [float("nan")])):
        with pytest.raises(InvalidArgument):
            vectors.late_interaction_search(g, bad[0], 3, bad[1])
    with pytest.raises(InvalidArgument):
        sketch.late_interaction_search_approximate(g, [E1], 3, 0)


def test_sets_traversal_and_search(spark):
    nodes = [("Root", {}, [E3]), ("Document", {"class": "eligible"}, [E2]), ("Document", {"class": "excluded"}, [E1]), ("Chunk", {}, [E4])]
    g = make(spark, nodes, [(0, 1, "LINKS"), (1, 3, "LINKS"), (3, 0, "LINKS")])
    roots, documents = filters.elements_with_label(g, "Root", NODES), filters.elements_with_label(g, "Document", NODES)
    one = traverse.expand(g, roots, OUT)
    assert ids(one) == {1} and ids(one, EDGE) == {0}
    assert rows(traverse.expand_hops(g, roots, 1, OUT)) == rows(one)
    two = traverse.expand_hops(g, roots, 2, OUT)
    assert ids(two) == {1, 3} and ids(two, EDGE) == {0, 1}
    three = traverse.expand_hops(g, roots, 3, OUT)
    assert ids(three) == {1, 3} and ids(three, EDGE) == {0, 1, 2}
    assert traverse.expand_hops(g, roots, 0, OUT).isEmpty()
    wanted = ElementFilter("Document", (("class", "eligible"),))
    assert filters.element_filter_plan(g, wanted, NODES) == planner.FilterPlan("property_posting", 1, 0)
    assert filters.element_filter_plan(g, ElementFilter("Root", (("class", "eligible"),)), NODES).strategy == "label_posting"
    assert filters.element_filter_plan(g, ElementFilter(), NODES) == planner.FilterPlan("full_scan", 4)
    eligible = filters.intersection(filters.intersection(one, documents), filters.elements_matching(g, wanted, NODES))
    assert filters.sizes(eligible) == (1, 0) and filters.sizes(filters.union(roots, eligible)) == (2, 0)
    assert ids(filters.difference(documents, eligible)) == {2}
    hits = vectors.vector_search_within(g, E1, eligible, 10)
    assert [h["id"] for h in hits.collect()] == [1]
    assert rows(sketch.vector_search_within_adaptive(g, E1, eligible, 10)[0]) == rows(hits)
    assert filters.contains(filters.insert(roots, EDGE, 9), EDGE, 9) and not filters.contains(filters.remove(roots, NODE, 0), NODE, 0)


def test_seeds_reappear_in_one_hop_only(spark):
    g = make(spark, [("N",)] * 2, [(0, 1, "E")])
    both = filters.element_set(g, [0, 1])
    assert ids(traverse.expand(g, both, OUT)) == {1}
    assert ids(traverse.expand_hops(g, both, 1, OUT)) == set()
    missing = filters.element_set(g, [7])
    with pytest.raises(NotFound):
        traverse.expand(g, missing)
    with pytest.raises(NotFound):
        traverse.nodes_within_hops(g, missing, 0)
    assert traverse.expand_hops(g, missing, 0).isEmpty()


def test_shortest_path(spark):
    g = make(spark, [("N",)] * 5, [(0, 1, "ROAD"), (0, 2, "ROAD"), (1, 3, "ROAD"), (2, 3, "ROAD"), (0, 1, "ROAD"), (0, 3, "NOISE")])
    assert traverse.shortest_path(g, 0, 3, direction=OUT).edges == [5]
    road = dict(max_hops=4, direction=OUT, label="ROAD")
    found = traverse.shortest_path(g, 0, 3, **road)
    assert (found.termination, found.nodes, found.edges) == ("found", [0, 1, 3], [0, 2])
    back = traverse.shortest_path(g, 3, 0, **(road | {"direction": IN}))
    assert (back.nodes, back.edges) == ([3, 1, 0], [2, 0])
    assert traverse.shortest_path(g, 0, 3, **(road | {"max_hops": 1})).termination == "not_found_within_hops"
    limited = traverse.shortest_path(g, 0, 3, **road, max_expansions=1)
    assert limited.termination == "expansion_limit" and limited.nodes is None
    assert (limited.expanded, limited.start_expanded, limited.end_expanded, limited.examined) == (1, 0, 1, 2)
    assert traverse.shortest_path(g, 4, 4, max_hops=0, max_expansions=0).nodes == [4]
    assert traverse.shortest_path(g, 0, 4, direction=OUT).termination == "not_found_within_hops"
    with pytest.raises(NotFound):
        traverse.shortest_path(g, 0, 99)
    path, steps = traverse.evidence_path(g, 3, 0, max_hops=4, direction=IN, label="ROAD")
    assert [(r["id"], r["edge"], r["forward"]) for r in steps.collect()] == [(3, None, None), (1, 2, False), (0, 0, False)]


def test_shortest_path_takes_the_cheaper_side(spark):
    edges = [(0, i, "LINK") for i in range(1, 257)] + [(0 if i == 257 else i - 1, i, "LINK") for i in range(257, 262)]
    g = make(spark, [("N",)] * 262, edges)
    r = traverse.shortest_path(g, 0, 261, max_hops=5, direction=OUT)
    assert (r.strategy, r.termination, r.edges) == ("bidirectional_breadth_first", "found", list(range(256, 261)))
    assert (r.expanded, r.start_expanded, r.end_expanded, r.visited, r.examined) == (5, 0, 5, 6, 5)
    assert traverse.shortest_path(g, 0, 257, max_hops=1, direction=OUT).strategy == "breadth_first"


def test_shortest_path_prefers_a_layer_that_fits(spark):
    edges = [(0, 1, "LINK"), (0, 2, "LINK"), (1, 3, "LINK")] + [(4 + i, 3, "LINK") for i in range(64)]
    g = make(spark, [("N",)] * 68, edges)
    r = traverse.shortest_path(g, 0, 3, max_hops=2, max_expansions=2, direction=OUT)
    assert (r.termination, r.edges, r.start_expanded, r.end_expanded) == ("found", [0, 2], 1, 1)


def test_numeric_ranges_keep_types_apart(spark):
    g = make(spark, [("Movie", {"rating": x}) for x in (8.0, 9.2, 9.8, 10)] + [("Movie", {"rating": float("nan")}), ("Movie", {"rating": None}), ("Movie", {})])
    assert ids(filters.elements_in_range(g, Range("rating", 9.2))) == {1, 2}
    assert ids(filters.elements_in_range(g, Range("rating", 8.0, 9.8, lower_inclusive=False, upper_inclusive=False))) == {1}
    assert ids(filters.elements_in_range(g, Range("rating", 9, 10))) == {3}
    assert ids(filters.elements_in_range(g, Range("rating", 9.9, 1.0))) == set()
    assert ids(filters.elements_matching(g, ElementFilter(None, (("rating", 10.0),)))) == set()
    assert ids(filters.elements_matching(g, ElementFilter(None, (("rating", None),)))) == {5}
    assert ids(filters.elements_matching(g, ElementFilter(None, (("rating", float("nan")),)))) == set()
    assert filters.numeric_range_plan(g, Range("rating", 9.2, label="Movie"), NODES) == planner.FilterPlan("numeric_posting", 2)
    for bad in (dict(lower=float("nan")), dict(), dict(lower=1, upper=2.0)):
        with pytest.raises(InvalidArgument):
            Range("rating", **bad)


def test_property_values_of_every_type(spark):
    values = {"b": True, "i": 3, "f": -0.0, "s": "x", "y": b"\x01", "n": model.Ref(NODE, 4), "e": model.Ref(EDGE, 4)}
    g = make(spark, [("N", values)])
    for key, value in values.items():
        assert ids(filters.elements_matching(g, ElementFilter("N", ((key, value),)))) == {0}, key
    assert ids(filters.elements_matching(g, ElementFilter("N", (("n", model.Ref(EDGE, 4)),)))) == set()
    assert ids(filters.elements_matching(g, ElementFilter("N", (("f", 0.0),)))) == {0}
    stored = g.nodes.first()["props"]
    assert {k: model.plain(v) for k, v in stored.items()} == values


def test_filtered_search(spark):
    g = make(spark, [("Movie", {"state": s, "rating": r}, [v]) for s, r, v in (("ok", 9.5, E1), ("ok", 7.0, E1), ("no", 9.9, E1), ("ok", 1, E2))])
    r = filtered.vector_search_filtered(g, E1, 5, ElementFilter("Movie", (("state", "ok"),)), [Range("rating", 9.0)])
    assert r.candidate_elements == 1 and [h["id"] for h in r.hits.collect()] == [0]
    assert filtered.vector_search_filtered(g, E1, 5, target=NODES).candidate_elements == 4
    assert filtered.vector_search_filtered(g, E1, 5, ElementFilter("Nobody")).hits.isEmpty()


def test_ties_keep_the_largest_and_show_the_smallest_first(spark):
    g = make(spark, [("N", {}, [E1])] * 4, [(0, 1, "E", {}, [E1])])
    hits = vectors.vector_search(g, E1, 3).collect()
    assert [(h["kind"], h["id"]) for h in hits] == [(NODE, 2), (NODE, 3), (EDGE, 0)]
    facets = make(spark, [("N", {}, [E2, E1, E1])])
    assert vectors.vector_search(facets, E1, 1).first()["facet"] == 1
    with pytest.raises(InvalidArgument):
        vectors.vector_search(g, [0.0] * 4, 1)
    with pytest.raises(InvalidArgument):
        vectors.vector_search(g, [1.0], 1)
    with pytest.raises(InvalidArgument):
        vectors.vector_search(g, [float("inf"), 0, 0, 0], 1)


def test_self_loops_and_neighbours(spark):
    g = make(spark, [("N",)] * 2, [(0, 0, "SELF"), (0, 0, "SELF"), (1, 0, "E")])
    assert rows(filters.visit_neighbors(g, 0)) == [(0, 0), (0, 1), (1, 2)]
    assert [r["id"] for r in filters.neighbors(g, 0).collect()] == [0, 1, 2]
    assert [r["id"] for r in filters.neighbors(g, 0, IN).collect()] == [0, 1, 2]
    assert dict(filters.degrees(g).collect()) == {0: 3, 1: 1}
    assert rows(pattern.match_one_hop(g, OneHop(direction="both"))) == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (1, 2, 0)]
    with pytest.raises(NotFound):
        filters.neighbors(g, 5)


def test_semantic_one_hop(spark):
    g = make(spark, [("Topic", {}, [E1]), ("Document", {}, [E1]), ("Document", {}, [E1]), ("Topic", {"x": 1})], [(0, 1, "SUPPORTS", {}, [E1]), (0, 2, "MENTIONS", {}, [E2]), (0, 3, "BARE")])
    found = pattern.match_semantic_one_hop(g, E1, OneHop(ElementFilter("Topic"))).collect()
    assert [(r["edge"], r["score"]) for r in found] == [(0, 1.0), (2, 1.0), (1, 0.75)]
    assert found[1]["edge_score"] is None and found[1]["end_score"] is None
    with pytest.raises(InvalidArgument):
        pattern.match_semantic_one_hop(g, E1, OneHop(), seed_count=0)


def test_semantic_paths(spark):
    mid = [0.8, 0.6, 0.0, 0.0]
    g = make(spark, [("N", {}, [E1]), ("N", {}, [mid]), ("N", {}, [E2]), ("N",)], [(0, 1, "E", {}, [E1]), (1, 2, "E", {}, [mid]), (0, 3, "E", {}, [E1])])
    o = semantic.SemanticPathOptions(seed_count=1)
    found = semantic.semantic_paths(g, E1, o).orderBy("rank").collect()
    first = (0.55 * 1 + 0.45 * (0.6 * 0.8 + 0.4)) * 0.92 - 0.04 * np.log1p(2)
    second = (0.55 * first + 0.45 * (0.4 * 0.8)) * 0.92 - 0.04 * np.log1p(1)
    assert [(r["node"], r["path"]) for r in found] == [(1, [0]), (2, [0, 1])]
    assert np.allclose([r["score"] for r in found], [first, second], atol=1e-6)
    seeds = semantic.semantic_paths(g, E1, semantic.SemanticPathOptions(include_seeds=True, max_hops=1), starts=[0]).collect()
    assert {r["node"] for r in seeds} == {0, 1}
    with pytest.raises(InvalidArgument):
        semantic.semantic_paths(g, E1, semantic.SemanticPathOptions(node_weight=0, edge_weight=0))
    with pytest.raises(NotFound):
        semantic.semantic_paths(g, E1, starts=[44])


def test_graph_range_filters_what_was_reached(spark):
    g = make(spark, [("N", {"scope": s}, [E1]) for s in ("keep", "drop", "keep", "keep", "drop")], [(0, 1, "LINK"), (1, 2, "LINK"), (0, 3, "OTHER")])
    keep = ElementFilter(None, (("scope", "keep"),))
    seeds = filters.element_set(g, [0])
    assert ids(traverse.nodes_within_hops(g, seeds, 2, OUT, "LINK", include_seeds=False)) == {1, 2}
    assert ids(traverse.nodes_within_hops(g, seeds, 2, OUT, "LINK", include_seeds=False, wanted=keep)) == {2}
    r = traverse.vector_search_graph_range(g, E1, seeds, hops=2, direction=OUT, label="LINK", include_seeds=False, wanted=keep)
    assert r.candidate_nodes == 1 and [h["id"] for h in r.hits.collect()] == [2]


def test_sketch(spark):
    assert [(sketch.width(d), sketch.words(d)) for d in (3, 64, 100, 128, 512, 768, 1024)] == [(4, 1), (64, 1), (128, 2), (512, 8), (512, 8), (1024, 8), (1024, 8)]
    x = np.random.default_rng(0).standard_normal((5, 64)).astype(np.float32)
    h = np.array([[1]])
    while len(h) < 64:
        h = np.block([[h, h], [h, -h]])
    a, b = sketch.signs(64, sketch.SEEDS[0]), sketch.signs(64, sketch.SEEDS[1])
    assert np.allclose(sketch.projected(x), ((x * a) @ h * b) @ h, atol=1e-2)
    assert set(np.unique(a)) == {-1, 1}
    angles = np.linspace(0, np.pi, 40, endpoint=False)
    circle = [[float(np.cos(t)), float(np.sin(t)), 0.0, 0.0] for t in angles]
    g = make(spark, [("Base", {}, [v]) for v in circle])
    exact = vectors.vector_search(g, circle[5], 1).first()
    assert sketch.vector_search_approximate(g, circle[5], 1, 8).first()["id"] == exact["id"] == 5
    assert rows(sketch.vector_search_approximate(g, circle[5], 3, 400)) == rows(vectors.vector_search(g, circle[5], 3))
    few = filters.element_set(g, [1, 2, 3])
    assert {r["id"] for r in sketch.vector_search_approximate(g, circle[5], 3, 5, within=few).collect()} == {1, 2, 3}
    with pytest.raises(InvalidArgument):
        sketch.vector_search_approximate(g, circle[5], 1, 0)
    stored = {r["id"]: r["sig"] for r in g.sketch.collect()}
    mine = sketch.signatures(np.asarray(circle, dtype=np.float32))
    distances = dict(g.sketch.select("id", sketch.hamming(model.F.col("sig"), mine[0])).collect())
    assert all(distances[i] == bin((s[0] ^ int(mine[0][0])) & (1 << 64) - 1).count("1") for i, s in stored.items())


def test_planner_constants():
    pairs = [((131072, 512), 131072), ((131073, 512), 20000), ((507949, 256), 20000), ((2000000, 256), 40000), ((1000000, 200, True), 12000), ((2000000, 200, True), 20000)]
    assert all(planner.unrestricted_budget(*a) == b for a, b in pairs)
    assert [planner.set_budget(*a) for a in ((10712, 768), (20588, 768), (100000, 200), (200000, 200))] == [10712, 5147, 100000, 20000]


def test_parser():
    q = pattern.parse("MATCH (c:Customer)-[r:PLACED]->(o:Order) RETURN c, r LIMIT 7;")
    assert q == OneHop(ElementFilter("Customer"), "PLACED", ElementFilter("Order"), OUT, 7)
    assert pattern.parse("match (a)<-[e]-(b) return *") == OneHop(direction=IN)
    assert pattern.parse("MATCH (a)-[e]-(b) RETURN a").direction == "both"
    for bad in ("MATCH (a)<-[e]->(b) RETURN a", "MATCH (a)-[e]->(b)", "MATCH ()-[e]->(b) RETURN b"):
        with pytest.raises(InvalidArgument):
            pattern.parse(bad)


def test_analytics(spark):
    g = make(spark, [("N",)] * 6, [(0, 1, "E"), (1, 2, "E"), (0, 1, "E"), (4, 3, "E")])
    assert rows(analytics.bfs(g, 0).na.fill(-1)) == [(0, 0), (1, 1), (2, 2), (3, -1), (4, -1), (5, -1)]
    assert rows(analytics.wcc(g)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)]
    found = dict(analytics.pagerank(g).collect())
    rank = np.full(6, 1 / 6)
    move = np.zeros((6, 6))
    move[1, 0] = move[2, 1] = move[3, 4] = 1
    for _ in range(10):
        rank = 0.15 / 6 + 0.85 * (move @ rank + rank[[2, 3, 5]].sum() / 6)
    assert np.allclose([found[i] for i in range(6)], rank, atol=1e-12)
    truth = analytics.bfs(g, 0)
    assert analytics.mismatches(analytics.with_sentinel(truth), analytics.with_sentinel(truth), "distance").isEmpty()


def test_hybrid_search(spark):
    texts = {"title": "Vector graphs"}, {"title": "Cooking pasta"}
    v = [embedding.hash_embedding(t["title"], 64).tolist() for t in texts]
    g = make(spark, [("Document", t, [x]) for t, x in zip(texts, v)], [(0, 1, "CONTRASTS_WITH", {"body": "vector graphs differ"}, [embedding.hash_embedding("vector graphs differ", 64).tolist()])], 64)
    r = explore.hybrid_search(g, " vector graphs ", 5)
    hits = r.hits.orderBy("rank").collect()
    assert r.warning is None and {(h["kind"], h["id"]) for h in hits[:2]} == {(NODE, 0), (EDGE, 0)}
    assert hits[0]["lexical"] is not None and hits[0]["semantic"] is not None
    assert hits[0]["id"] == 0 and hits[0]["lexical"] == 1.0

    def broken(text, dimension):
        raise RuntimeError("no network")

    assert explore.hybrid_search(g, "vector", 5, embed=broken).warning
    with pytest.raises(RuntimeError):
        explore.hybrid_search(g, "vector", 5, explore.SEMANTIC, broken)
    with pytest.raises(InvalidArgument):
        explore.hybrid_search(g, "  ")
    title = explore.titled(g, explore.hybrid_search(g, "pasta", 1, explore.TEXT).hits).first()
    assert title["title"] == "Cooking pasta"


def test_focus_and_snapshots(spark):
    edges = [(0, 1, "COMMON"), (0, 2, "COMMON"), (0, 3, "COMMON"), (0, 4, "RARE"), (1, 5, "CHILD"), (2, 6, "CHILD"), (3, 7, "CHILD"), (4, 8, "CHILD")]
    g = make(spark, [("Node",)] * 9, edges)
    whole = explore.snapshot(g)
    assert not whole.sampled and dict(whole.nodes.select("id", "degree").collect())[0] == 4
    f = explore.focus(whole, node=0, depth=2, node_budget=7, edge_budget=10)
    assert len(f.layers) == 3 and len(f.nodes) <= 7 and len(f.edges) <= 10
    assert 4 in f.layers[1] and {1, 2, 3} & set(f.layers[1]) and f.layers[2]
    assert all(c in f.nodes and p in f.nodes for c, p in f.parents.items())
    assert explore.focus(whole, node=99) is None and explore.focus(whole, edge=3).layers[0] == [0, 4]
    part = explore.snapshot(g, 4, 3)
    assert part.sampled and part.nodes.count() == 3 and part.edges.count() <= 3  # the stride's one node was chosen already
    more = explore.including_path(part, g, [0, 4, 8], [3, 7])
    assert {0, 4, 8} <= {r["id"] for r in more.nodes.collect()}
    assert explore.is_forest(whole) and explore.orbit(whole).count() == 9


def test_point_reads(spark):
    g = make(spark, [("A", {"name": "x"}, [E1, E2]), ("B",), ("A",)], [(0, 1, "E", {"w": 1})])
    assert filters.node(g, 0).first()["label"] == "A" and filters.node(g, 9).isEmpty()
    assert filters.edge(g, 0).first()["target"] == 1
    assert [r["id"] for r in filters.nodes_with_label(g, "A").collect()] == [2, 0]
    assert filters.vector(g, NODE, 0, 1).first()["vec"] == E2 and filters.vector(g, NODE, 0, 2).isEmpty()
    assert {r[0] for r in filters.symbols(g).collect()} == {"A", "B", "E", "name", "w"}
    assert rows(filters.label_counts(g)) == [("A", 2), ("B", 1)]
    assert ids(filters.elements_matching(g, ElementFilter(None, (("w", 1),)), EDGES), EDGE) == {0}


def test_predicates_are_asked_from_the_cheapest_on(spark, monkeypatch):
    g = make(spark, [("M", {"a": i % 2, "b": i % 10, "c": float(i)}, [E1]) for i in range(40)])
    asked = []
    whole = filters._flat
    monkeypatch.setattr(filters, "_flat", lambda graph, target, label, key: asked.append(key) or whole(graph, target, label, key))
    r = filtered.vector_search_filtered(g, E1, 50, ElementFilter("M", (("a", 1),)), [Range("c", 10.0), Range("b", 3, 3)], NODES)
    assert asked == ["b", "a", "c"] and r.candidate_elements == 3 and {h["id"] for h in r.hits.collect()} == {13, 23, 33}
    assert [p.upper_bound for p in (r.equality_plan, *r.range_plans)] == [20, 30, 4]
    asked.clear()
    nothing = filtered.vector_search_filtered(g, E1, 5, ElementFilter("M", (("a", 7),)), [Range("c", 10.0)], NODES)
    assert asked == ["a"] and nothing.hits.isEmpty() and nothing.candidate_elements == 0
    assert {r["id"] for r in filtered.vector_search_filtered(g, E1, 50, ElementFilter("M"), [Range("b", 9)]).hits.collect()} == {9, 19, 29, 39}


def test_a_pattern_runs_as_it_is_planned(spark):
    nodes = [("Seed", {}, [E1]), ("Target", {}, [E2])] + [("Noise",)] * 49
    g = make(spark, nodes, [(0, 1, "UNIQUE"), (0, 0, "UNIQUE")] + [(2 + i, 3 + i, "NOISE") for i in range(48)])
    for direction in (OUT, IN, "both"):
        q = OneHop(ElementFilter("Seed"), "UNIQUE", direction=direction)
        found = [rows(pattern.matches(g, q, planner.OneHopPlan(way, 0, 0, 0, 0))) for way in ("edge_scan", "start_adjacency", "end_adjacency")]
        assert found[0] == found[1] == found[2] and found[0]
    assert pattern.plan(g, OneHop(ElementFilter("Seed"))).strategy == "start_adjacency"
    assert rows(pattern.matches(g, OneHop(ElementFilter("Seed")))) == [(0, 0, 1), (0, 1, 0)]


def test_logged_vectors_are_always_scored(spark):
    angles = np.linspace(0, np.pi, 40, endpoint=False)
    g = make(spark, [("Base", {}, [[float(np.cos(t)), float(np.sin(t)), 0.0, 0.0]]) for t in angles] + [("Far", {}, [E3])])
    q = [1.0, 0.0, 0.2, 0.0]
    assert 40 not in {r["id"] for r in sketch.shortlist(g, vectors.prepared_query(g, q), 3, NODES, None, None).collect()}
    g.logged = filters.element_set(g, [40])
    near = sketch.with_logged(g, sketch.shortlist(g, vectors.prepared_query(g, q), 3, NODES, None, None), NODES, None, None)
    assert 40 in {r["id"] for r in near.collect()}
    assert sketch.with_logged(g, near, NODES, "Base", None).where("id = 40").count() == 1  # it was there before
    assert sketch.eligible_count(g, NODES, "Far", None) == 1 and sketch.eligible_count(g, NODES, None, filters.element_set(g, [1, 2])) == 2
    assert rows(sketch.vector_search_approximate(g, q, 1, 1, NODES, "Far")) == rows(vectors.vector_search(g, q, 1, NODES, "Far"))


def test_paths_beyond_what_one_task_holds(spark):
    rng = np.random.default_rng(5)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(0, 1, 4))
    g = make(spark, [("N", {}, [unit()]) for _ in range(30)], [(int(a), int(b), "E", {}, [unit()]) for a, b in rng.integers(0, 30, (80, 2))])
    for o in (dict(seed_count=4, max_hops=3, limit=50), dict(seed_count=2, max_hops=2, max_expansions=7, direction=OUT)):
        whole = semantic.semantic_paths(g, E1, semantic.SemanticPathOptions(**o))
        fetched = semantic.semantic_paths(g, E1, semantic.SemanticPathOptions(**o, gathered_edges=1))
        assert rows(whole) == rows(fetched) and whole.count() > 3


def test_layers_of_a_traversal(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b), "E") for a, b in rng.integers(0, 120, (150, 2))] + [(i, i + 1, "E") for i in range(100, 119)]
    g = make(spark, [("N",)] * 120, links)
    for direction in (OUT, "both"):
        near = {i: set() for i in range(120)}
        for a, b, _ in links:
            near[a].add(b)
            if direction == "both":
                near[b].add(a)
        reached, frontier = {0}, {0}
        for _ in range(25):
            frontier = set().union(*(near[i] for i in frontier), set()) - reached
            reached |= frontier
        assert ids(traverse.nodes_within_hops(g, filters.element_set(g, [0]), 25, direction)) == reached
    chain = make(spark, [("N",)] * 24, [(i, i + 1, "E") for i in range(23)])
    assert rows(analytics.bfs(chain, 2).na.fill(-1)) == [(0, -1), (1, -1)] + [(i, i - 2) for i in range(2, 24)]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_shortlists_of_many_queries_are_those_of_each(spark, monkeypatch, chunk):
    monkeypatch.setattr(sketch, "CHUNK", chunk)
    monkeypatch.setattr(sketch, "DISTANCES", 3 * chunk)
    monkeypatch.setattr(sketch, "KEPT", 40)
    rng = np.random.default_rng(3)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(0, 1, 4))
    g = make(spark, [("N", {}, [unit() for _ in range(1 + i % 3)]) for i in range(60)], [(0, 1, "E", {}, [unit()])])
    g.vectors = g.vectors.repartition(3)
    queries = [unit() for _ in range(7)]
    for budget, target in ((10, NODES), (100, NODES), (9, (NODE, EDGE))):
        alone = {(i, *r) for i, q in enumerate(queries) for r in sketch.shortlist(g, vectors.prepared_query(g, q), budget, target, None, None).collect()}
        together = sketch.shortlist_many(g, queries, budget, target)
        assert set(map(tuple, together.collect())) == alone
    assert together.count() == 7 * 9


def test_recall_of_many_queries_is_one_plan(spark):
    """A plan for each query would grow with the vectors."""
    from quiverspark import queries as registry

    plan = registry.queries()["v14_recall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Union") <= 2 and plan.count("MapInArrow") <= 4


def test_searches_do_not_depend_on_the_size(spark, monkeypatch):
    """Where a sketch would be planned the nearest by sketch alone would miss the true nearest."""
    monkeypatch.setattr(planner, "EXACT_COMPONENTS", 0)
    monkeypatch.setattr(planner, "EXACT_SET_COMPONENTS", {"wide": 0, "narrow": 0})
    monkeypatch.setattr(planner, "_clamp", lambda n, low, high: 3)
    rng = np.random.default_rng(6)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(0, 1, 4))
    g = make(spark, [("N", {"a": i % 2}, [unit()]) for i in range(80)], [(i, i + 1, "E") for i in range(79)])
    q, every = unit(), filters.elements_with_label(g, "N", NODES)
    truth = rows(vectors.vector_search(g, q, 10))
    assert planner.vector_search_plan(g, NODES).strategy == "sketch"
    assert rows(sketch.vector_search_approximate(g, q, 10, 10)) != truth
    for hits, plan in (sketch.vector_search_adaptive(g, q, 10), sketch.vector_search_within_adaptive(g, q, every, 10)):
        assert rows(hits) == truth and (plan.strategy, plan.vectors, plan.budget) == ("exact", 80, 80)
    assert rows(filtered.vector_search_filtered(g, q, 10, ElementFilter("N")).hits) == truth
    assert rows(traverse.vector_search_graph_range(g, q, every).hits) == truth
    late = rows(vectors.late_interaction_search(g, [q, E1], 10).select("id", "score"))
    assert rows(sketch.late_interaction_adaptive(g, [q, E1], 10)[0].select("id", "score")) == late
    semantic_hits = {(r["id"], r["facet"]) for r in explore.hybrid_search(g, "words", 10, explore.SEMANTIC, lambda text, n: q).hits.collect()}
    assert semantic_hits == {(r["id"], r["facet"]) for r in vectors.vector_search(g, q, 10).collect()}


def test_lexical_search_asks_a_label_once_and_numbers_only_where_they_may_match(spark):
    g = make(spark, [("Nation_7", {"name": "x", "n": 7}), ("B", {"name": "a nation_7", "n": 70}), ("B", {"w": 1e20})], [(0, 1, "TO_NATION_7", {"w": 0.5})])
    assert explore._never_in_numbers(["nation_7"]) and not explore._never_in_numbers(["nation_7", "7"]) and not explore._never_in_numbers(["1.0e20"])
    found = {(r["kind"], r["id"]): r["score"] for r in explore.lexical_search(g, "NATION_7", 9).collect()}
    assert found == {(NODE, 0): round(1.2 * 2.4, 9), (NODE, 1): round(1.5 * 1.9, 9), (EDGE, 0): round(1.2 * 1.9, 9)}
    assert {(r["kind"], r["id"]) for r in explore.lexical_search(g, "7", 9).collect()} == {(NODE, 0), (NODE, 1), (EDGE, 0)}
    assert {(r["kind"], r["id"]) for r in explore.lexical_search(g, "1.0e20", 9).collect()} == {(NODE, 2)}
    plan = explore.titled(g, g.elements_of(NODES).select("kind", "id"), NODES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan


def test_a_whole_snapshot_is_neither_ordered_nor_limited_in_one_task(spark):
    """Also an orbit: no window without a partition, no heap of all edges."""
    g = make(spark, [("N",)] * 40, [(i, (i * 7) % 40, "E") for i in range(40)])
    whole = explore.snapshot(g, 1 << 30, 1 << 30)
    for frame in (whole.nodes, whole.edges, explore.orbit(whole)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan and "Window" not in plan
    degree = [0] * 40
    for i in range(40):
        degree[i] += 1
        degree[(i * 7) % 40] += 1
    assert rows(whole.nodes.select("id", "degree")) == list(enumerate(degree)) and not whole.sampled
    at = {r["id"]: (round(r["x"], 9), round(r["y"], 9)) for r in explore.orbit(whole).collect()}
    assert at == {i: (round(float(np.cos(2 * np.pi * i / 40)), 9), round(float(np.sin(2 * np.pi * i / 40)), 9)) for i in range(40)}
    g.edges = g.edges.unionByName(spark.createDataFrame([(99, 0, 77, "E", {}, 1)], model.EDGES_DDL))  # ends nowhere
    assert rows(explore.snapshot(g, 1 << 30, 1 << 30).nodes.select("id", "degree")) == list(enumerate(degree))


def test_places_in_an_order_sort_only_the_ranges_that_have_them(spark, monkeypatch):
    ids = sorted({int(x) ** 2 for x in np.random.default_rng(4).integers(0, 3000, 900)})
    frame = spark.createDataFrame([(i, -i) for i in ids], "id bigint, v bigint").repartition(5)
    for ranges in (4, 1 << 16):
        monkeypatch.setattr(explore, "RANGES", ranges)
        monkeypatch.setattr(explore, "HEAP", 3)
        for stride, limit in ((2, 10_000), (7, 20), (400, 9), (5000, 3)):
            assert [r["id"] for r in explore._nth(frame, "id", stride, limit)] == ids[::stride][:limit]
        for limit in (2, 50, 10_000):
            assert sorted(r["id"] for r in explore._first(frame, "id", limit).collect()) == ids[:limit]


@pytest.mark.parametrize("rows_at_once, scores, kept", [(1 << 13, 1 << 22, 1 << 22), (5, 15, 12)])
def test_many_queries_hold_a_bounded_number_of_scores(spark, monkeypatch, rows_at_once, scores, kept):
    monkeypatch.setattr(vectors, "ROWS", rows_at_once)
    monkeypatch.setattr(vectors, "SCORES", scores)
    monkeypatch.setattr(vectors, "KEPT", kept)
    rng = np.random.default_rng(12)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).tolist())(rng.normal(0, 1, 4))
    few = [unit() for _ in range(6)]  # shared vectors, so that scores tie
    g = make(spark, [("N", {}, [few[(i * f) % 6] if f else unit() for f in range(1 + i % 3)]) for i in range(50)])
    queries = [unit() for _ in range(11)]
    found = vectors.vector_search_many(g, queries, 4)
    wanted = []
    for n, q in enumerate(queries):
        best = {}
        for r in g.vectors.collect():
            s = round(float(np.dot(np.float64(r["vec"]), q)), 9)
            best[r["kind"], r["id"]] = max(best.get((r["kind"], r["id"]), (-9, 0)), (s, -r["facet"]))
        top = sorted(((s, *e, -f) for e, (s, f) in best.items()), key=lambda x: (-x[0], -x[1], -x[2]))[:4]
        wanted += [(n, *e, f, s) for s, *e, f in top]
    assert rows(found.select("query", "kind", "id", "facet")) == sorted((a, b, c, d) for a, b, c, d, _ in wanted)


def test_embeddings_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(9)
    texts = ["", " ", "?!", "a", "ab", "abc abc", "Größe ÄÖ straße", "x_1 y-2", "日本語 テキスト", "é" * 9] + ["".join(rng.choice(list("abc_ Z9é-"), rng.integers(0, 40))) for _ in range(200)]
    for dimension in (0, 1, 7, 64, 300):
        many = embedding.hash_embeddings(texts, dimension)
        assert all((m == embedding.hash_embedding(t, dimension)).all() for m, t in zip(many, texts, strict=True))


def test_a_set_is_broadcast_and_kinds_that_it_lacks_are_not_read(spark, no_broadcasts):
    g = make(spark, [("N", {}, [E1]), ("N", {}, [E2])], [(0, 1, "E", {}, [E1])])
    asked, whole = [], g.vectors_of
    g.vectors_of = lambda target, label=None: asked.append(target) or whole(target, label)
    hits = vectors.vector_search_within(g, E1, filters.element_set(g, [0]), 3)
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert asked == [(NODE,)] and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [(r["kind"], r["id"]) for r in hits.collect()] == [(NODE, 0)]
    both = vectors.vector_search_within(g, E1, filters.element_set(g, [1], [0]), 3)
    assert [(r["kind"], r["id"]) for r in both.collect()] == [(EDGE, 0), (NODE, 1)]
    assert vectors.vector_search_within(g, E1, filters.element_set(g), 3).isEmpty()


def test_first_edges_are_an_aggregate(spark):
    from quiverspark.sources import files

    edges = spark.createDataFrame([(0, 1, "E", 5, "b"), (0, 1, "E", 3, "a"), (0, 1, "F", 9, None), (1, 0, "E", 2, "c")], "source bigint, target bigint, label string, seq bigint, x string")
    first = files.first_edges(edges)
    assert first.columns == edges.columns and rows(first.fillna("-")) == [(0, 1, "E", 3, "a"), (0, 1, "F", 9, "-"), (1, 0, "E", 2, "c")]
    assert "Window" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_written_by_many_tasks_in_order(spark, tmp_path):
    from quiverspark.queries_store import _lines
    from quiverspark.sources.rows import lines

    path = _lines(spark.range(5000).repartition(3), ["id"], model.F.col("id").cast("string"), str(tmp_path / "v"))
    told = lines(spark, path)
    assert rows(told) == [(i, str(i)) for i in range(5000)] and len(told.sparkSession.read.text(path).inputFiles()) > 1


def test_rank_moves_the_edges_once(spark, monkeypatch, no_broadcasts):
    g = make(spark, [("N",)] * 30, [(i % 30, (i * 7) % 30, "E") for i in range(90)])
    plans, write = [], analytics.write_bucketed
    monkeypatch.setattr(analytics, "write_bucketed", lambda df, *rest, **more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *rest, **more))
    assert abs(sum(r["rank"] for r in analytics.pagerank(g).collect()) - 1) < 1e-9
    assert plans[0].count("RepartitionByExpression [source") == 2  # one exchange, used twice by both sides of the join
