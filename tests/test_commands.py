"""Commands, the source-tree importer and layouts."""

import math

import pytest

from quiverspark import commands
from quiverspark.functions.embedding import hash_embedding
from quiverspark.model import NODES, InvalidArgument
from quiverspark.operators import explore
from quiverspark.sources import source_tree, store
from tests.conftest import rows
from tests.test_graph import make


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "pkg"
    (root / "sub").mkdir(parents=True)
    (root / "a.py").write_text("def add(x, y):\n    return x + y\n\n\nclass Shape:\n    sides = 3\n")
    (root / "sub/b.py").write_text("import os\n")
    (root / "bad.py").write_text("def (:\n")
    (root / "notes.txt").write_text("no source")
    return source_tree.import_source_tree(spark, str(tmp_path_factory.mktemp("g") / "g"), str(root))


def test_source_tree(tree):
    g = tree.graph
    counts = g.count("nodes")
    assert counts["Repository"] == 1 and counts["File"] == 3
    assert g.count("edges")["CONTAINS"] == 3 and g.count("edges")["HAS_SYNTAX"] == 3
    assert g.count("edges")["AST_CHILD"] == counts["Syntax"] - 3
    named = {r[0] for r in g.nodes.where("label = 'Syntax'").selectExpr("props['name'].s").collect()}
    assert {"add", "Shape", "sides"} <= named
    errors = g.nodes.where("label = 'Syntax' AND props['has_error'].tag = 2")
    assert errors.count() == 1
    store.verify_integrity(g)
    assert g.vectors.count() == 2 * counts["Syntax"]
    assert source_tree.files_of(g).count() == 3


def run(spark, tree, *arguments):
    return commands.run(spark, commands._parser().parse_args([tree.path, *map(str, arguments)]))


def test_commands(spark, tree, tmp_path):
    assert run(spark, tree, "stats").first()["nodes"] == tree.graph.node_count
    assert run(spark, tree, "check").where("n > 0").isEmpty()
    assert run(spark, tree, "query", "MATCH (r:Repository)-[c:CONTAINS]->(f:File) RETURN f").count() == 3
    assert run(spark, tree, "query-text", "MATCH (s:Syntax)-[c:AST_CHILD]->(t:Syntax) RETURN t LIMIT 2", "class Shape").count() == 2
    hit = run(spark, tree, "search-text", "FunctionDef add", "--target", "nodes", "--label", "Syntax").first()
    assert tree.graph.nodes.where(f"id = {hit['id']}").first()["props"]["name"]["s"] == "add"
    assert run(spark, tree, "search", "Shape", "--limit", 3).count() == 3
    assert run(spark, tree, "search-facets", "class Shape || sides || ", "--limit", 4).count() == 4
    assert run(spark, tree, "range-text", "add", 0, "--hops", 2, "--direction", "out").count() > 0
    assert run(spark, tree, "semantic-text", "class Shape").count() >= 0
    assert run(spark, tree, "neighbors", 0, "--label", "CONTAINS").count() == 3
    assert run(spark, tree, "node", 0).first()["concise"] == "pkg"
    path = run(spark, tree, "shortest-path", 1, 2).collect()
    assert [r["id"] for r in path] == [1, 0, 2]
    assert run(spark, tree, "numeric-range", "bytes", "--lower", 0.5).count() == 0
    assert run(spark, tree, "compact", tmp_path / "c").first()["transactions"] == 0
    assert run(spark, tree, "export-csv", tmp_path / "csv") is None
    with pytest.raises(InvalidArgument):
        run(spark, tree, "search-text", "x", "--label", "Nobody")
    commands.main([tree.path, "stats"])


def test_layouts(spark):
    g = make(spark, [("N",)] * 6, [(0, 1, "E"), (0, 2, "E"), (1, 3, "E")])
    part = explore.snapshot(g)
    placed = {r["id"]: r for r in explore.radial_forest(part).collect()}
    assert len(placed) == 6 and [placed[i]["depth"] for i in range(6)] == [0, 1, 1, 2, 0, 0]
    assert all(abs(math.hypot(r["x"], r["y"]) - (r["depth"] + 1)) < 1e-9 for r in placed.values())
    assert len(rows(explore.orbit(part))) == 6
    assert hash_embedding("x", 4).shape == (4,) and NODES == (0,)
