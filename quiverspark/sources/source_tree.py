"""A folder of Python sources as a graph: repository, files, syntax elements.

Nodes: Repository{name, path}, File{path, bytes, language}, Syntax{kind, start_line, end_line,
start_byte, end_byte, has_error, name, text}.  Edges: CONTAINS from the repository to files,
HAS_SYNTAX from a file to its root, AST_CHILD{child_index, field} between elements.  Every
syntax element owns two vectors: of its kind and name, and of its text.  Files are read and
parsed in parallel; a file that does not parse is one element with ``has_error``.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark.functions.embedding import hash_embedding
from quiverspark.model import FALSE, INT, PROPS_DDL, STRING, TRUE, props_column, value_column
from quiverspark.plans.workspace import write_table
from quiverspark.sources import store
from quiverspark.sources.rows import numbered

TEXT_CHARACTERS = 240
ELEMENT_DDL = "path string, place int, parent int, child_index int, field string, kind string, name string, start_line int, end_line int, start_byte int, end_byte int, has_error boolean, text string"


def elements_of(path: str, source: str) -> list[tuple]:
    """Rows of ``ELEMENT_DDL`` of one file, the root first, parents before children."""
    starts = [0]
    for line in source.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [(path, 0, None, 0, None, "Module", None, 1, max(1, source.count("\n")), 0, len(source.encode()), True, source[:TEXT_CHARACTERS])]
    rows, todo = [], [(tree, None, 0, None)]
    while todo:
        node, parent, index, field = todo.pop(0)
        place = len(rows)
        first, last = getattr(node, "lineno", 1), getattr(node, "end_lineno", len(starts) - 1)
        start = starts[first - 1] + getattr(node, "col_offset", 0)
        end = starts[last - 1] + node.end_col_offset if hasattr(node, "end_col_offset") else len(source.encode())
        text = source.encode()[start:end].decode("utf-8", "replace")[:TEXT_CHARACTERS]
        name = next((v for k in ("name", "id", "attr", "arg") if isinstance(v := getattr(node, k, None), str)), None)
        rows.append((path, place, parent, index, field, type(node).__name__, name, first, last, start, end, False, text))
        children = [(c, f) for f, v in ast.iter_fields(node) for c in (v if isinstance(v, list) else [v]) if isinstance(c, (ast.stmt, ast.expr, ast.excepthandler, ast.arguments, ast.arg))]
        todo += [(c, place, i, f) for i, (c, f) in enumerate(children)]
    return rows


def import_source_tree(spark: SparkSession, path: str, root: str, dimension: int = 64) -> store.Store:
    """A new graph of all ``*.py`` files below ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = elements_of(name, content.decode("utf-8", "replace"))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELEMENT_DDL.split(", ")]).astype({"parent": "Int32"})

    elements = write_table(found.select("path", "content").mapInPandas(parse, ELEMENT_DDL), "elements")
    paths = numbered(found.select("path", "length"), ["path"], "n").select("path", "length", (F.col("n") + 1).alias("file"))
    n_files = paths.count()
    placed = numbered(elements, ["path", "place"], "n").withColumn("id", F.col("n") + 1 + n_files).join(paths.select("path", "file"), "path")
    text = lambda c: value_column(STRING, F.col(c))
    number = lambda c: value_column(INT, F.col(c))
    one = F.lit(1).cast("bigint").alias("generation")
    empty = F.expr(f"cast(map() AS {PROPS_DDL})")
    repository = spark.createDataFrame([(0, PurePosixPath(root).name, root)], "id bigint, name string, path string")
    nodes = repository.select("id", F.lit("Repository").alias("label"), props_column(name=text("name"), path=text("path")).alias("props"), one)
    nodes = nodes.unionByName(paths.withColumn("language", F.lit("python")).select(F.col("file").alias("id"), F.lit("File").alias("label"), props_column(path=text("path"), bytes=number("length"), language=text("language")).alias("props"), one))
    error = F.when(F.col("has_error"), value_column(TRUE)).otherwise(value_column(FALSE))
    props = props_column(kind=text("kind"), start_line=number("start_line"), end_line=number("end_line"), start_byte=number("start_byte"), end_byte=number("end_byte"), has_error=error, text=text("text"))
    named = F.when(F.col("name").isNotNull(), F.map_concat(props, props_column(name=text("name")))).otherwise(props)
    nodes = nodes.unionByName(placed.select("id", F.lit("Syntax").alias("label"), named.alias("props"), one))
    contains = paths.select(F.lit(0).cast("bigint").alias("source"), F.col("file").alias("target"), F.lit("CONTAINS").alias("label"), empty.alias("props"))
    roots = placed.where("parent IS NULL").select(F.col("file").alias("source"), F.col("id").alias("target"), F.lit("HAS_SYNTAX").alias("label"), empty.alias("props"))
    above = placed.select("path", F.col("place").alias("parent"), F.col("id").alias("source"))
    child = placed.where("parent IS NOT NULL").join(above, ["path", "parent"])
    links = child.select("source", F.col("id").alias("target"), F.lit("AST_CHILD").alias("label"), props_column(child_index=number("child_index"), field=text("field")).alias("props"))
    edges = numbered(contains.unionByName(roots).unionByName(links), ["label", "source", "target"], "id").withColumn("generation", F.lit(1).cast("bigint"))

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(0, r.id, facet, "Syntax", hash_embedding(t, dimension)) for r in frame.itertuples(index=False) for facet, t in enumerate((r.title, r.text))]
            yield pd.DataFrame(out, columns=["kind", "id", "facet", "label", "vec"])

    title = F.concat_ws(" ", "kind", "name").alias("title")
    vectors = placed.select("id", title, "text").mapInPandas(embed, "kind tinyint, id bigint, facet int, label string, vec array<float>")
    store.bulk_load(spark, path, nodes, edges.select("id", "source", "target", "label", "props", "generation"), vectors, dimension)
    return store.open_graph(spark, path)


def files_of(graph) -> DataFrame:
    """Files of an imported tree with their number of syntax elements below the root's children."""
    has = graph.edges.where("label = 'HAS_SYNTAX'").select(F.col("source").alias("id"), F.col("target").alias("root"))
    below = graph.edges.where("label = 'AST_CHILD'").groupBy(F.col("source").alias("root")).agg(F.count("*").alias("children"))
    return graph.nodes.where("label = 'File'").select("id", F.col("props")["path"]["s"].alias("path")).join(has, "id").join(below, "root", "left").select("id", "path", F.coalesce("children", F.lit(0)).alias("children"))
