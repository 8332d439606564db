"""Commands over a stored graph: text in, rows out.

The functions take a graph and plain arguments and return frames, so they serve programs as
well as ``python -m quiverspark.commands GRAPH COMMAND ...``.  Unlike a pattern, whose
unknown label matches nothing, a command's unknown label is an error.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark.functions.embedding import hash_embedding
from quiverspark.graph import Graph
from quiverspark.model import BOTH, BOTH_KINDS, EDGES, NODES, InvalidArgument
from quiverspark.operators import explore, filters, pattern, semantic, sketch, traverse
from quiverspark.sources import files, jsonl, store

Embed = Callable[[str, int], Sequence[float]]
TARGETS = {"nodes": NODES, "edges": EDGES, "both": BOTH_KINDS}


def known_label(graph: Graph, label: str | None) -> str | None:
    if label is not None and label not in graph.count("nodes") and label not in graph.count("edges"):
        raise InvalidArgument(f"no element has the label {label}")
    return label


def search_text(graph: Graph, words: str, k: int = 10, target: tuple[int, ...] = BOTH_KINDS, label: str | None = None, embed: Embed = hash_embedding) -> DataFrame:
    """The elements nearest to an embedded text."""
    return sketch.vector_search_adaptive(graph, embed(words, graph.dimension), k, target, known_label(graph, label))[0]


def range_text(graph: Graph, words: str, seeds: Sequence[int], k: int = 10, hops: int = 2, direction: str = BOTH, edge_label: str | None = None, embed: Embed = hash_embedding) -> DataFrame:
    """The nearest nodes around some seeds, which may be among them."""
    near = filters.element_set(graph, list(seeds))
    return traverse.vector_search_graph_range(graph, embed(words, graph.dimension), near, k, hops, direction, known_label(graph, edge_label)).hits


def search_facets(graph: Graph, facets: str, k: int = 10, weights: Sequence[float] | None = None, target: tuple[int, ...] = BOTH_KINDS, label: str | None = None, embed: Embed = hash_embedding) -> DataFrame:
    """Late interaction of several texts, separated by ``||``; blank ones are left out."""
    texts = [t.strip() for t in facets.split("||") if t.strip()]
    return sketch.late_interaction_adaptive(graph, [embed(t, graph.dimension) for t in texts], k, weights, target, known_label(graph, label))[0]


def semantic_text(graph: Graph, words: str, options: semantic.SemanticPathOptions = semantic.SemanticPathOptions(), embed: Embed = hash_embedding) -> DataFrame:
    """Best-first paths from the nodes nearest to a text."""
    known_label(graph, options.seed_label)
    known_label(graph, options.edge_label)
    return semantic.semantic_paths(graph, embed(words, graph.dimension), options)


def show_node(graph: Graph, identifier: int) -> DataFrame:
    filters.require_nodes(graph, [identifier])
    return pattern.concise(filters.node(graph, identifier))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quiverspark", description=__doc__)
    p.add_argument("graph", help="folder of a stored graph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> None:
        s = sub.add_parser(name)
        for names, options in arguments:
            s.add_argument(*names, **options)

    def arg(*names, **options):
        return names, options

    limit, label = arg("--limit", type=int, default=10), arg("--label")
    target, direction = arg("--target", choices=TARGETS, default="both"), arg("--direction", choices=["out", "in", "both"], default="both")
    command("create", arg("dimension", type=int), arg("--similarity", default="cosine"))
    command("import-jsonl", arg("nodes"), arg("edges"), arg("dimension", type=int))
    command("import-fbin", arg("file"), arg("--metadata"))
    command("import-plain", arg("vertices"), arg("edges"))
    command("export-csv", arg("path"))
    command("compact", arg("path"))
    command("stats")
    command("check")
    command("node", arg("id", type=int))
    command("neighbors", arg("id", type=int), direction, label)
    command("numeric-range", arg("key"), arg("--lower", type=float), arg("--upper", type=float), limit, target, label)
    command("query", arg("text"))
    command("query-text", arg("text"), arg("words"))
    command("search-text", arg("words"), limit, target, label)
    command("search", arg("words"), arg("--mode", choices=["text", "semantic", "hybrid"], default="hybrid"), limit)
    command("search-facets", arg("facets"), limit, target, label)
    command("range-text", arg("words"), arg("seeds", type=int, nargs="+"), arg("--hops", type=int, default=2), direction, limit)
    command("semantic-text", arg("words"), limit)
    command("shortest-path", arg("start", type=int), arg("end", type=int), arg("--max-hops", type=int, default=6), direction, label)
    return p


def parsed(arguments: Sequence[str] | None = None) -> argparse.Namespace:
    return _parser().parse_args(arguments)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The frame that a parsed command gives, or None for one that writes."""
    made = {
        "create": lambda: store.create(spark, a.graph, a.dimension, a.similarity),
        "import-jsonl": lambda: jsonl.import_jsonl(spark, a.graph, a.nodes, a.edges, a.dimension),
        "import-fbin": lambda: files.import_fbin(spark, a.graph, a.file, metadata=a.metadata),
        "import-plain": lambda: files.import_plain_graph(spark, a.graph, a.vertices, a.edges),
    }
    if a.command in made:
        return store.stats(made[a.command]().graph)
    opened = store.open_graph(spark, a.graph, read_only=True)
    g = opened.graph
    if a.command == "export-csv":
        return files.export_csv(g, a.path)
    if a.command == "compact":
        return store.stats(store.compact_to(opened, a.path).graph)
    target = TARGETS[getattr(a, "target", "both")]
    commands: dict[str, Callable[[], DataFrame]] = {
        "stats": lambda: store.stats(g),
        "check": lambda: store.check(g),
        "node": lambda: show_node(g, a.id),
        "neighbors": lambda: filters.neighbors(g, a.id, a.direction, known_label(g, a.label)),
        "numeric-range": lambda: filters.numeric_range(g, filters.Range(a.key, a.lower, a.upper, known_label(g, a.label)), a.limit, target),
        "query": lambda: pattern.query(g, a.text),
        "query-text": lambda: pattern.query_text(g, a.text, hash_embedding, a.words),
        "search-text": lambda: search_text(g, a.words, a.limit, target, a.label),
        "search": lambda: explore.titled(g, explore.hybrid_search(g, a.words, a.limit, a.mode).hits).orderBy("rank"),
        "search-facets": lambda: search_facets(g, a.facets, a.limit, target=target, label=a.label),
        "range-text": lambda: range_text(g, a.words, a.seeds, a.limit, a.hops, a.direction),
        "semantic-text": lambda: semantic_text(g, a.words, semantic.SemanticPathOptions(limit=a.limit)),
        "shortest-path": lambda: traverse.evidence_path(g, a.start, a.end, max_hops=a.max_hops, direction=a.direction, label=known_label(g, a.label))[1],
    }
    return commands[a.command]()


def main(arguments: Sequence[str] | None = None) -> None:
    a = parsed(arguments)
    spark = SparkSession.builder.appName("quiverspark").getOrCreate()
    found = run(spark, a)
    if found is not None:
        shown = [F.to_json(c).alias(c) if kind.startswith("map") else F.col(c) for c, kind in found.dtypes]
        found.select(*shown).show(1000, truncate=False)


if __name__ == "__main__":
    main()
