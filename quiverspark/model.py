"""Data model: typed property values, element kinds, schemas and errors."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE, EDGE = 0, 1
NODES, EDGES, BOTH_KINDS = (NODE,), (EDGE,), (NODE, EDGE)

#: Tags of the property value types.
NULL, FALSE, TRUE, INT, FLOAT, STRING, BYTES, NODE_REF, EDGE_REF = 0, 1, 2, 3, 4, 5, 6, 7, 8

VALUE_DDL = "struct<tag: tinyint, i: bigint, f: double, s: string, x: binary>"
PROPS_DDL = f"map<string, {VALUE_DDL}>"
NODES_DDL = f"id bigint, label string, props {PROPS_DDL}, generation bigint"
EDGES_DDL = f"id bigint, source bigint, target bigint, label string, props {PROPS_DDL}, generation bigint"
VECTORS_DDL = "kind tinyint, id bigint, facet int, label string, vec array<float>"
PROPS_TABLE_DDL = "kind tinyint, id bigint, label string, key string, tag tinyint, i bigint, f double, s string, x binary"
ADJACENCY_DDL = "node bigint, direction tinyint, neighbor bigint, edge bigint, label string"
OUT, IN, BOTH = "out", "in", "both"


class GraphError(Exception):
    """Any error of the engine."""


class InvalidArgument(GraphError, ValueError):
    """An argument that no graph could answer."""


class NotFound(GraphError, KeyError):
    """An element that is not there."""

    def __init__(self, kind: str, identifier: Any):
        super().__init__(f"{kind} {identifier} does not exist")


class Conflict(GraphError):
    """A change that contradicts another one or the graph."""


class Corrupt(GraphError):
    """Stored data or an imported file that breaks the rules."""


@dataclass(frozen=True)
class Ref:
    """A property value that names a node or an edge."""

    kind: int
    id: int


def typed(value: Any) -> tuple[int, Any]:
    """(tag, payload) of a Python value.  Int and Float stay apart; None is the stored null."""
    if value is None:
        return NULL, None
    if isinstance(value, bool):
        return (TRUE if value else FALSE), None
    if isinstance(value, int):
        return INT, value
    if isinstance(value, float):
        return FLOAT, value
    if isinstance(value, str):
        return STRING, value
    if isinstance(value, (bytes, bytearray)):
        return BYTES, bytes(value)
    if isinstance(value, Ref):
        return (NODE_REF if value.kind == NODE else EDGE_REF), value.id
    raise InvalidArgument(f"a property can't hold {type(value).__name__}")


def value_row(value: Any) -> tuple:
    """A value as the fields of ``VALUE_DDL``."""
    tag, payload = typed(value)
    return (tag, payload if tag in (INT, NODE_REF, EDGE_REF) else None, payload if tag == FLOAT else None, payload if tag == STRING else None, payload if tag == BYTES else None)


def plain(row: Any) -> Any:
    """The Python value of a stored one."""
    tag = row["tag"]
    if tag == NULL:
        return None
    if tag in (FALSE, TRUE):
        return tag == TRUE
    if tag in (NODE_REF, EDGE_REF):
        return Ref(NODE if tag == NODE_REF else EDGE, row["i"])
    return row[{INT: "i", FLOAT: "f", STRING: "s", BYTES: "x"}[tag]]


def value_column(tag: int, payload: Column | None = None) -> Column:
    """A value struct from a column that holds the payload."""
    none = F.lit(None)
    return F.struct(
        F.lit(tag).cast("tinyint").alias("tag"),
        (payload if tag in (INT, NODE_REF, EDGE_REF) else none).cast("bigint").alias("i"),
        (payload if tag == FLOAT else none).cast("double").alias("f"),
        (payload if tag == STRING else none).cast("string").alias("s"),
        (payload if tag == BYTES else none).cast("binary").alias("x"),
    )


def props_column(**values: Column) -> Column:
    """A property map from value structs by key."""
    parts: list[Column] = []
    for key, value in values.items():
        parts += [F.lit(key), value]
    return F.create_map(*parts) if parts else F.expr(f"cast(map() AS {PROPS_DDL})")


def equals(value: Column, wanted: Any) -> Column:
    """Whether a stored value equals ``wanted``: types never mix, NaN matches nothing; null for a missing key.

    A plain conjunction, so that a filter on the flat table of properties reaches the files.
    """
    tag, payload = typed(wanted)
    same = value["tag"] == tag
    if tag in (INT, NODE_REF, EDGE_REF):
        same &= value["i"] == F.lit(payload).cast("bigint")
    elif tag == FLOAT:
        same &= F.lit(False) if math.isnan(payload) else value["f"] == F.lit(payload)
    elif tag == STRING:
        same &= value["s"] == F.lit(payload)
    elif tag == BYTES:
        same &= value["x"] == F.lit(payload)
    return same


def label_text(value: Column) -> Column:
    """A searchable value as text; null for stored nulls and bytes."""
    return (
        F.when(value["tag"] == STRING, value["s"])
        .when(value["tag"] == TRUE, F.lit("true"))
        .when(value["tag"] == FALSE, F.lit("false"))
        .when(value["tag"].isin(INT, NODE_REF, EDGE_REF), value["i"].cast("string"))
        .when(value["tag"] == FLOAT, F.when((value["f"] == F.floor(value["f"])) & (F.abs(value["f"]) < 1e15), value["f"].cast("bigint").cast("string")).otherwise(value["f"].cast("string")))
    )
