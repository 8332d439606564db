"""Interchange files: nodes and edges as JSON lines, with ids of the file's own.

Every rule is a column expression over the lines, so a file is read in parallel; the first
offence by line number is reported with its file and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark.graph import COSINE
from quiverspark.model import FALSE, FLOAT, INT, NULL, PROPS_DDL, STRING, TRUE, Corrupt
from quiverspark.sources import store
from quiverspark.sources.rows import lines, numbered
from quiverspark.plans.workspace import write_table

NODE_FIELDS = {"id", "label", "properties", "vectors"}
EDGE_FIELDS = {"source", "target", "label", "properties", "vectors"}
METADATA_FIELDS = {"label", "properties"}


def _kind(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def _property(variant: Column) -> Column:
    """A JSON scalar as a typed value: whole numbers that fit are Int, other numbers Float."""
    kind = _kind(variant)
    tag = (
        F.when(variant.isNull() | (kind == "VOID"), NULL)
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(variant, "$", "boolean"), TRUE).otherwise(FALSE))
        .when(kind == "BIGINT", INT)
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), FLOAT)
        .when(kind == "STRING", STRING)
    )
    return F.struct(
        tag.cast("tinyint").alias("tag"),
        F.when(kind == "BIGINT", F.try_variant_get(variant, "$", "bigint")).alias("i"),
        F.when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(variant, "$", "double")).alias("f"),
        F.when(kind == "STRING", F.try_variant_get(variant, "$", "string")).alias("s"),
        F.lit(None).cast("binary").alias("x"),
    )


def _external(variant: Column) -> Column:
    """An id of the file, typed, so that "1" and 1 differ; null where it is neither text nor a whole number."""
    kind = _kind(variant)
    return F.when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(variant, "$", "string"))).when(kind == "BIGINT", F.concat(F.lit("i:"), F.try_variant_get(variant, "$", "bigint").cast("string")))


def _fail(frame: DataFrame, bad: Column, path: str, what: str) -> None:
    row = frame.where(bad).orderBy("line").select("line").first()
    if row is not None:
        raise Corrupt(f"{path}:{row['line'] + 1}: {what}")


def parsed(spark: SparkSession, path: str, fields: set[str], required: set[str], dimension: int | None) -> DataFrame:
    """Non-blank lines as line, v (variant), label, props, vecs; raises on the first bad line."""
    text = lines(spark, path).where(F.trim("text") != "")
    frame = text.withColumn("v", F.try_parse_json("text"))
    frame = frame.withColumn("keys", F.map_keys(F.try_variant_get("v", "$", "map<string, variant>")))
    frame = write_table(frame.withColumn("v", F.to_json("v")).withColumnRenamed("v", "json"), "jsonl").withColumn("v", F.try_parse_json("json"))
    _fail(frame, F.col("v").isNull() | F.col("keys").isNull(), path, "not a JSON object")
    unknown = F.array_except("keys", F.array(*[F.lit(f) for f in sorted(fields)]))
    _fail(frame, F.size(unknown) > 0, path, "an unknown field")
    missing = F.array_except(F.array(*[F.lit(f) for f in sorted(required)]), "keys")
    _fail(frame, F.size(missing) > 0, path, "a missing field")
    label = F.try_variant_get("v", "$.label", "string")
    _fail(frame, label.isNull() | (_kind(F.try_variant_get("v", "$.label", "variant")) != "STRING"), path, "a label that is no text")
    raw = F.try_variant_get("v", "$.properties", "map<string, variant>")
    frame = frame.withColumn("label", label).withColumn("raw", raw)
    _fail(frame, F.array_contains("keys", "properties") & F.col("raw").isNull(), path, "properties that are no object")
    props = F.coalesce(F.transform_values("raw", lambda _, v: _property(v)), F.expr(f"cast(map() AS {PROPS_DDL})"))
    frame = frame.withColumn("props", props).drop("raw")
    _fail(frame, F.exists(F.map_values("props"), lambda p: p["tag"].isNull()), path, "a property that is no scalar")
    if "vectors" in fields:
        vecs = F.coalesce(F.try_variant_get("v", "$.vectors", "array<array<float>>"), F.expr("cast(array() AS array<array<float>>)"))
        frame = frame.withColumn("vecs", vecs)
        bad = F.exists("vecs", lambda x: x.isNull() | (F.size(x) != dimension) | F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))))
        _fail(frame, bad | (F.array_contains("keys", "vectors") & F.try_variant_get("v", "$.vectors", "array<array<float>>").isNull()), path, "vectors that are not lists of the graph's dimension")
    return frame


def import_jsonl(spark: SparkSession, path: str, nodes_file: str, edges_file: str, dimension: int, similarity: str = COSINE) -> store.Store:
    """A new graph from a file of nodes and one of edges.  Ids become dense in line order."""
    nodes = parsed(spark, nodes_file, NODE_FIELDS, {"id", "label"}, dimension).withColumn("key", _external(F.try_variant_get("v", "$.id", "variant")))
    _fail(nodes, F.col("key").isNull(), nodes_file, "an id that is neither text nor a whole number")
    twice = nodes.groupBy("key").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1")
    _fail(twice, F.lit(True), nodes_file, "an id that was used before")
    edges = parsed(spark, edges_file, EDGE_FIELDS, {"source", "target", "label"}, dimension)
    for end in ("source", "target"):
        edges = edges.withColumn(f"{end}_key", _external(F.try_variant_get("v", f"$.{end}", "variant")))
    ids = numbered(nodes.select("key", "line"), ["line"], "id").select("key", "id")
    for end in ("source", "target"):
        _fail(edges.join(ids, edges[f"{end}_key"] == ids["key"], "left_anti"), F.lit(True), edges_file, f"a {end} that no node has")
        edges = edges.join(ids.withColumnRenamed("id", end).withColumnRenamed("key", f"{end}_key"), f"{end}_key")
    edge_ids = numbered(edges.select("line"), ["line"], "id")
    one = F.lit(1).cast("bigint").alias("generation")
    full_nodes = nodes.join(ids, "key").select("id", "label", "props", one, "vecs")
    full_edges = edges.join(edge_ids, "line").select("id", "source", "target", "label", "props", one, "vecs")
    vectors = None
    for kind, frame in ((0, full_nodes), (1, full_edges)):
        part = frame.select(F.lit(kind).cast("tinyint").alias("kind"), "id", "label", F.posexplode("vecs").alias("facet", "vec")).select("kind", "id", "facet", "label", "vec")
        vectors = part if vectors is None else vectors.unionByName(part)
    store.bulk_load(spark, path, full_nodes.drop("vecs"), full_edges.drop("vecs"), vectors, dimension, similarity)
    return store.open_graph(spark, path)
