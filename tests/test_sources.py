"""Stores, transactions, importers, exports, streams and text functions."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverspark import model
from quiverspark.functions import embedding, text
from quiverspark.graph import adjacency_of
from quiverspark.model import EDGE, NODE, Conflict, Corrupt, InvalidArgument, NotFound
from quiverspark.operators import filters, sketch, traverse, vectors
from quiverspark.operators.filters import ElementFilter
from quiverspark.sources import files, jsonl, store
from quiverspark.sources.rows import lines, numbered
from quiverspark.streaming import mutations
from tests.conftest import rows

E1, E2, E3, E4 = np.eye(4).tolist()


def test_persistence_and_hits(spark, tmp_path):
    s = store.create(spark, f"{tmp_path}/g", 4)
    t = s.transaction()
    project = t.create_node("Project", {"name": "q"}, [E1])
    file = t.create_node("File", {"path": "a"}, [E2, [0.0, 3.0, 4.0, 0.0]])
    t.create_edge(project, file, "CONTAINS", vecs=[E3])
    assert t.commit() == 1
    again = store.open_graph(spark, f"{tmp_path}/g", read_only=True)
    assert store.stats(again.graph).first().asDict() == {"nodes": 2, "edges": 1, "labels": 5, "vectors": 4, "transactions": 1}
    hits = vectors.vector_search(again.graph, E1, 3).collect()
    assert len(hits) == 3 and (hits[0]["kind"], hits[0]["id"]) == (NODE, project)
    assert np.allclose(filters.vector(again.graph, NODE, file, 1).first()["vec"], [0, 0.6, 0.8, 0])
    store.verify_integrity(again.graph)
    with pytest.raises(InvalidArgument):
        store.create(spark, f"{tmp_path}/g", 4)
    locked = again.transaction()
    locked.create_node("N")
    with pytest.raises(InvalidArgument):
        locked.commit()
    with pytest.raises(Corrupt):
        store.open_graph(spark, f"{tmp_path}/nothing")
    assert s.transaction().commit() == 1  # nothing to do


def test_updates_deletes_and_compaction(spark, tmp_path):
    s = store.create(spark, f"{tmp_path}/g", 4)
    t = s.transaction()
    a, b = t.create_node("Item", {"state": "old"}, [E1]), t.create_node("Item", {"state": "old"}, [E2])
    e = t.create_edge(a, b, "LINK", {"state": "old"}, [E3])
    t.commit()
    old = ElementFilter(None, (("state", "old"),))
    assert rows(filters.elements_matching(s.graph, old)) == [(NODE, a), (NODE, b), (EDGE, e)]
    t = s.transaction()
    t.update_node(a, "Item", {"state": "new"}, [E4])
    t.update_edge(e, "LINK", {"state": "new"})
    c = t.create_node("Item", {"state": "new"})
    t.commit()
    assert rows(filters.elements_matching(s.graph, old)) == [(NODE, b)]
    assert rows(filters.elements_matching(s.graph, ElementFilter(None, (("state", "new"),)))) == [(NODE, a), (NODE, c), (EDGE, e)]
    assert filters.node(s.graph, a).first()["generation"] == 2
    assert sketch.vector_search_approximate(s.graph, E4, 1, 1).first()["id"] == a
    t = s.transaction()
    t.delete_node(b)
    with pytest.raises(Conflict):
        t.commit()
    t = s.transaction()
    t.delete_node(b)
    t.delete_edge(e)
    t.commit()
    assert s.graph.node_count == 2 and s.graph.edge_count == 0
    with pytest.raises(NotFound):
        t = s.transaction()
        t.delete_edge(e)
        t.commit()
    with pytest.raises(Conflict):
        t = s.transaction()
        t.update_node(a, "Item")
        t.delete_node(a)
    t = s.transaction()
    f = t.create_edge(a, c, "LINK")
    t.commit()
    t = s.transaction()
    t.delete_node(c, detach=True)
    t.commit()
    assert rows(s.graph.nodes.select("id")) == [(a,)] and s.graph.edges.isEmpty()
    assert {r["id"] for r in vectors.vector_search(s.graph, E2, 5).collect()} == {a}
    small = store.compact_to(s, f"{tmp_path}/small")
    assert small.transactions == s.transactions and small.graph.transactions == s.transactions
    assert rows(small.graph.nodes.select("id", "generation")) == [(a, 2)]
    t = small.transaction()
    assert t.create_node("N") == a + 1 and f == 0 + 1  # a new base counts from what it holds
    t.commit()
    assert small.transactions == s.transactions + 1
    assert store.warm_vector_cache(small.graph) == 16


def test_bad_changes(spark, tmp_path):
    s = store.create(spark, f"{tmp_path}/g", 4)
    for bad in ([1.0], [0.0] * 4, [float("nan"), 0, 0, 0]):
        with pytest.raises(InvalidArgument):
            s.transaction().create_node("N", vecs=[bad])
    t = s.transaction()
    t.create_edge(0, 1, "E")
    with pytest.raises(NotFound):
        t.commit()
    with pytest.raises(InvalidArgument):
        model.typed([1])
    first = s.transaction()
    dropped = first.create_node("N")
    second = s.transaction()
    assert second.create_node("N") == dropped + 1


def test_a_torn_transaction_is_not_seen(spark, tmp_path):
    s = store.create(spark, f"{tmp_path}/g", 4)
    t = s.transaction()
    t.create_node("N")
    t.commit()
    (tmp_path / "g/log/txn=2").mkdir()
    (tmp_path / "g/log/txn=2/part-0.parquet").write_bytes(b"PAR1 torn")
    assert store.open_graph(spark, f"{tmp_path}/g").transactions == 1


def test_stored_adjacency_is_not_shuffled(spark, tmp_path):
    nodes = spark.range(50).selectExpr("id", "'N' AS label", f"cast(map() AS {model.PROPS_DDL}) AS props", "1L AS generation")
    edges = spark.range(200).selectExpr("id", "id % 50 AS source", "(id * 7) % 50 AS target", "'E' AS label", f"cast(map() AS {model.PROPS_DDL}) AS props", "1L AS generation")
    store.bulk_load(spark, f"{tmp_path}/g", nodes, edges, spark.createDataFrame([], model.VECTORS_DDL), 4)
    g = store.open_graph(spark, f"{tmp_path}/g").graph
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = g.adjacency.join(spark.range(1000).withColumnRenamed("id", "node"), "node", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # of the frontier only
    assert rows(traverse.expand(g, filters.element_set(g, [1])).where("kind = 1")) == [(1, r) for r in sorted({i for i in range(200) if i % 50 == 1 or i * 7 % 50 == 1})]


def test_predicates_reach_the_files(spark, tmp_path):
    s = store.create(spark, f"{tmp_path}/g", 4)
    t = s.transaction()
    for k in range(5):
        t.create_node("N", {"k": k, "w": float(k)})
    t.commit()
    g = store.compact_to(s, f"{tmp_path}/h").graph
    for found in (filters.elements_in_range(g, filters.Range("k", 2)), filters.elements_matching(g, ElementFilter("N", (("k", 2),)))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :]
        assert "EqualTo(key,k)" in pushed and "IsNotNull(tag)" in pushed and "IsNotNull(i)" in pushed and "map<" not in plan
    assert filters.elements_in_range(g, filters.Range("k", 2)).count() == 3
    both = filters.elements_satisfying(g, ElementFilter("N"), [filters.Range("k", 1), filters.Range("w", None, 2.0)])
    assert {r["id"] for r in both.collect()} == {1, 2}


def write_jsonl(path, records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(path)


def test_import_jsonl(spark, tmp_path):
    nodes = [{"id": "c1", "label": "Customer", "properties": {"name": "Ada", "active": True}, "vectors": [E1]}, {"id": 1, "label": "Product", "properties": {"price": 129.0, "sku": "x", "n": 3, "none": None}, "vectors": [E2]}, {"id": "1", "label": "Product", "vectors": [E3]}]
    edges = [{"source": "c1", "target": 1, "label": "PURCHASED", "properties": {"quantity": 2}, "vectors": [E1]}, {"source": "c1", "target": "1", "label": "PURCHASED", "vectors": [E4]}]
    n, e = write_jsonl(tmp_path / "n.jsonl", nodes), write_jsonl(tmp_path / "e.jsonl", edges)
    g = jsonl.import_jsonl(spark, f"{tmp_path}/g", n, e, 4).graph
    assert (g.node_count, g.edge_count, g.vectors.count()) == (3, 2, 5)
    assert rows(g.edges.select("id", "source", "target")) == [(0, 0, 1), (1, 0, 2)]
    props = {k: model.plain(v) for k, v in g.nodes.where("id = 1").first()["props"].items()}
    assert props == {"price": 129.0, "sku": "x", "n": 3, "none": None} and isinstance(props["n"], int)
    bad = [
        ([*nodes, nodes[0]], edges, "n.jsonl:4"),
        ([{"id": 1, "label": "P", "extra": 1}], [], "n.jsonl:1"),
        (["{oops"], [], "n.jsonl:1"),
        ([{"id": 1.5, "label": "P"}], [], "n.jsonl:1"),
        ([{"id": 1, "label": "P", "properties": {"x": [1]}}], [], "n.jsonl:1"),
        ([{"id": 1, "label": "P", "vectors": [[1.0]]}], [], "n.jsonl:1"),
        (nodes, [edges[0], {"source": "c1", "target": "nobody", "label": "X"}], "e.jsonl:2"),
        (nodes, [{"source": "c1", "label": "X"}], "e.jsonl:1"),
    ]
    for i, (ns, es, where) in enumerate(bad):
        n, e = write_jsonl(tmp_path / "n.jsonl", ns), write_jsonl(tmp_path / "e.jsonl", es)
        with pytest.raises(Corrupt, match=where):
            jsonl.import_jsonl(spark, f"{tmp_path}/bad{i}", n, e, 4)


def write_fbin(path, x):
    x = np.asarray(x, dtype="<f4")
    path.write_bytes(struct.pack("<II", *x.shape) + x.tobytes())
    return str(path)


def test_import_fbin(spark, tmp_path):
    f = write_fbin(tmp_path / "v.fbin", [E1, E2, [0, 0, 3, 4]])
    g = files.import_fbin(spark, f"{tmp_path}/g", f).graph
    assert g.node_count == 3 and vectors.vector_search(g, E2, 1).first()["id"] == 1
    m = write_jsonl(tmp_path / "m.jsonl", [{"label": "A", "properties": {"k": 1}}, "", {"label": "B"}, {"label": "A"}])
    h = files.import_fbin(spark, f"{tmp_path}/h", f, metadata=m).graph
    assert rows(h.nodes.select("id", "label")) == [(0, "A"), (1, "B"), (2, "A")]
    with pytest.raises(Corrupt):
        files.import_fbin(spark, f"{tmp_path}/i", f, metadata=write_jsonl(tmp_path / "m2.jsonl", [{"label": "A"}]))
    (tmp_path / "bad.fbin").write_bytes(struct.pack("<II", 2, 4) + b"\0" * 16)
    with pytest.raises(Corrupt):
        files.read_matrix(spark, str(tmp_path / "bad.fbin"))


def test_import_plain_graph(spark, tmp_path):
    (tmp_path / "g.v").write_text("# ids\n2\n5\n9 more\n")
    (tmp_path / "g.e").write_text("2 5 0.5\n# note\n9 2\n")
    g = files.import_plain_graph(spark, f"{tmp_path}/g", f"{tmp_path}/g.v", f"{tmp_path}/g.e").graph
    assert rows(g.edges.select("source", "target")) == [(0, 1), (2, 0)]
    (tmp_path / "bad.v").write_text("2\n2\n")
    with pytest.raises(Corrupt, match="bad.v:2"):
        files.read_plain_graph(spark, f"{tmp_path}/bad.v", f"{tmp_path}/g.e")
    (tmp_path / "bad.e").write_text("2 7\n")
    with pytest.raises(Corrupt, match="bad.e:1"):
        files.read_plain_graph(spark, f"{tmp_path}/g.v", f"{tmp_path}/bad.e")


def test_export_csv(spark, tmp_path):
    s = store.create(spark, f"{tmp_path}/g", 4)
    t = s.transaction()
    f = t.create_node("File", {"path": 'a "b", c'})
    x = t.create_node("Syntax", {"kind": "fn", "text": "t"})
    y = t.create_node("Syntax", {"kind": "id", "name": "n", "text": "t"})
    t.create_edge(f, x, "HAS_SYNTAX")
    t.create_edge(x, y, "AST_CHILD")
    t.commit()
    files.export_csv(s.graph, f"{tmp_path}/out")
    read = lambda n: rows(spark.read.csv(f"{tmp_path}/out/{n}", header=True, quote='"', escape='"'))
    assert read("files") == [("0", 'a "b", c')] and read("syntax") == [("1", "fn", "t"), ("2", "id", "n")]
    assert read("has_syntax") == [("0", "1", "0")] and read("ast_child") == [("1", "2", "1")]


def test_upserts(spark):
    df = spark.createDataFrame([("a", 1, 0, "x"), ("b", 5, 1, "y"), ("a", 3, 2, "z"), ("a", 3, 3, "w")], "key string, rank int, seq int, v string")
    assert rows(files.ranked_upsert(df).select("key", "v", "place")) == [("a", "z", 0), ("b", "y", 1)]
    edges = spark.createDataFrame([(1, "L", 2, 5), (1, "L", 2, 3), (1, "M", 2, 9)], "source long, label string, target long, seq int")
    assert rows(files.first_edges(edges).select("seq")) == [(3,), (9,)]


def test_stream_of_mutations(spark, tmp_path):
    path = f"{tmp_path}/g"
    store.create(spark, path, 4)
    props = {"x": model.value_row(1)}
    first = spark.createDataFrame([("put", NODE, 0, None, None, "N", props, [E1]), ("put", NODE, 1, None, None, "N", props, []), ("put", EDGE, 0, 0, 1, "E", {}, [])], mutations.CHANGES_DDL)
    first.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(mutations.CHANGES_DDL).parquet(f"{tmp_path}/in/*")
    mutations.follow(stream, path, f"{tmp_path}/cp").awaitTermination()
    assert store.stats(store.open_graph(spark, path).graph).first()["edges"] == 1
    second = spark.createDataFrame([("delete", EDGE, 0, None, None, None, {}, [])], mutations.CHANGES_DDL)
    second.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    mutations.follow(spark.readStream.schema(mutations.CHANGES_DDL).parquet(f"{tmp_path}/in/*"), path, f"{tmp_path}/cp").awaitTermination()
    g = store.open_graph(spark, path)
    assert g.graph.edges.isEmpty() and g.graph.node_count == 2
    assert not mutations.append(spark, path, second, 0, "mutations")  # replayed batch


def test_numbered_rows_and_lines(spark, tmp_path):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x")
    got = numbered(df, ["x"], "n").collect()
    assert len(got) == 1000 and all(r["x"] == r["n"] for r in got)
    (tmp_path / "t.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    assert [r["text"] for r in lines(spark, f"{tmp_path}/t.txt").orderBy("line").collect()] == [f"line {i}" for i in range(500)]


def test_hash_embedding(spark):
    v = embedding.hash_embedding("Hello world_1", 16)
    assert abs(float((v * v).sum()) - 1) < 1e-5 and np.allclose(v, embedding.hash_embedding("hELLO, world_1!", 16))
    assert embedding.fnv1a(b"") == 0xCBF29CE484222325 and embedding.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    expected = np.zeros(8)
    h = embedding.fnv1a(b"ab")
    expected[h % 8] = -1 if h >> 63 else 1
    assert np.allclose(embedding.hash_embedding("ab", 8), expected)
    assert abs(np.abs(embedding.hash_embedding("...", 8)).sum() - 1) < 1e-6
    df = spark.createDataFrame([("x",), ("x",), (None,)], "t string")
    assert [r[0] is None for r in df.select(embedding.hash_embed("t", 4)).collect()] == [False, False, True]
    assert embedding.embed_unique(df, "t", None, 4).where("embedding IS NOT NULL").count() == 2
    calls = []

    def flaky(texts, dimension):
        calls.append(len(texts))
        if len(calls) < 3:
            raise RuntimeError("busy")
        return np.ones((len(texts), dimension))

    assert embedding.remote_embedder(flaky, pause=0)(["a", "b"], 3).shape == (2, 3) and calls == [2, 2, 2]
    with pytest.raises(InvalidArgument):
        embedding.remote_embedder(lambda t, d: np.ones((1, 1)), pause=0)(["a"], 3)


def test_text_functions(spark):
    df = spark.createDataFrame([("  " + "é" * 100 + " ",), ("ok",), (None,)], "t string")
    got = [r[0] for r in df.select(text.bounded_bytes(F.col("t"), 20)).collect()]
    assert got == ["é" * 8 + "…", "ok", None]
    assert spark.range(1).select(text.ascii_lower(F.lit("ÄBc"))).first()[0] == "Äbc"
    clip = spark.range(1).select(text.clipped(F.lit("a  b\n" + "c" * 20), 10)).first()[0]
    assert clip == "a b ccccc…"
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("nonsense",)], "t string")
    assert [r[0] for r in times.select(text.epoch_millis(F.col("t"))).collect()] == [1704164645000, None]
    s = lambda t, p: spark.range(1).select(text.score_text(F.lit(t), p, p.split(), 2.0)).first()[0]
    assert (s("a b", "a b"), s("x a b", "a b"), s("a", "a b"), s("q", "a b")) == (4.8, 3.8, 1.0, 0.0)


def bulk(spark, path, n=50, m=200):
    nodes = spark.range(n).selectExpr("id", "'N' AS label", f"cast(map() AS {model.PROPS_DDL}) AS props", "1L AS generation")
    edges = spark.range(m).selectExpr("id", f"id % {n} AS source", f"(id * 7) % {n} AS target", "'E' AS label", f"cast(map() AS {model.PROPS_DDL}) AS props", "1L AS generation")
    store.bulk_load(spark, path, nodes, edges, spark.createDataFrame([], model.VECTORS_DDL), 4)
    return store.open_graph(spark, path)


def test_the_adjacency_survives_a_transaction(spark, tmp_path):
    s = bulk(spark, f"{tmp_path}/g")
    t = s.transaction()
    new = t.create_edge(1, 2, "E")
    t.delete_edge(1)
    t.commit()
    t = s.transaction()
    t.delete_node(3, detach=True)
    t.commit()
    g = s.graph
    assert rows(g.adjacency) == rows(adjacency_of(g.edges)) and new in {r["edge"] for r in g.adjacency.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = g.adjacency.join(spark.range(1000).withColumnRenamed("id", "node"), "node", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # what is shuffled: the frontier, and the log's own few links; not the stored links
    lines_ = plan.splitlines()
    at = next(i for i, line in enumerate(lines_) if "quiverspark_adjacency" in line)
    join = max(i for i in range(at) if "SortMergeJoin" in lines_[i])
    assert "Bucketed: true" in lines_[at] and not any("Exchange" in line for line in lines_[join:at])
    assert rows(filters.neighbors(g, 1).select("id")) == [(i,) for i in sorted({i for i in range(200) if 1 in (i % 50, i * 7 % 50) and 3 not in (i % 50, i * 7 % 50)} - {1} | {new})]


def test_a_replayed_batch_counts_once(spark, tmp_path):
    path = f"{tmp_path}/g"
    s = bulk(spark, path, 4, 8)
    gone = spark.createDataFrame([("delete", NODE, 1, None, None, None, {}, [])], mutations.CHANGES_DDL)
    (tmp_path / "g/log/txn=1").mkdir(parents=True)  # an attempt that broke off
    (tmp_path / "g/log/txn=1/part-0.parquet").write_bytes(b"torn")
    assert mutations.append(spark, path, gone, 0, "a") and not mutations.append(spark, path, gone, 0, "a")
    assert mutations.append(spark, path, gone.limit(0), 1, "a") is False
    assert store.committed(spark, path) == [1]
    s.refresh()
    assert s.graph.node_count == 3 and not [r for r in s.graph.edges.collect() if 1 in (r["source"], r["target"])]
    assert rows(s.graph.adjacency) == rows(adjacency_of(s.graph.edges))
    again = spark.createDataFrame([("put", NODE, 9, None, None, "N", {}, [])], mutations.CHANGES_DDL)
    assert mutations.append(spark, path, again, 0, "b") and store.open_graph(spark, path).transactions == 2


def test_buckets_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "partitions_for", lambda frame: 7)
    s = bulk(spark, f"{tmp_path}/g")
    assert s.graph.buckets == 7
    assert store.compact_to(s, f"{tmp_path}/h", 3).graph.buckets == 3


def test_the_fixture_writes_what_a_query_asks_for(spark):
    """Checks of arguments need no graph, a store of customers no line items, searches of nodes no edges' vectors."""
    from quiverspark import queries as registry
    from quiverspark.sources import fixture

    fixture._LOADED.clear()
    sf, run = "/root/testdata/sf0.001", registry.queries()
    graph = fixture.graph(spark, sf)
    for name in ("p06_range_validation", "m02_create_edge", "m06_conflicts", "s03_read_only", "x03_titles", "v01_many_queries", "v14_recall", "p02_elements_matching"):
        run[name](spark, sf).collect()
        assert not {"items", "edges", "adjacency"} & set(graph.__dict__), name
    assert set(graph._parts) == {("vectors", 0), ("sketch", 0)}
    run["t13_degree"](spark, sf).collect()
    assert "adjacency" not in graph.__dict__
    run["g04_mismatches"](spark, sf).collect()
    assert "adjacency" in graph.__dict__ and ("vectors", 1) not in graph._parts
