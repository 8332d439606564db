"""Mutations as a stream: batches of changes become transactions of a stored graph.

A stream of change records (op, kind, id, source, target, label, props, vecs) is written one
transaction per micro-batch.  The batch's name is part of the transaction's rows, which become
visible together: a batch that Spark replays after a failure either finds its transaction and
changes nothing, or finds a torn one, which no reader sees, and writes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiverspark.model import EDGE, NODE
from quiverspark.sources import store

CHANGES_DDL = store.LOG_DDL.replace("txn bigint, op_order tinyint, ", "")


MARKED_DDL = "stream string, batch bigint"


def append(spark: SparkSession, path: str, changes: DataFrame, batch: int, stream: str) -> bool:
    """Write one batch as a transaction; False if it was written before, or holds nothing.

    Of several changes to one element in a batch the last by ``seq`` counts (a batch without
    ``seq`` must not repeat elements).  The edges of a deleted node are deleted with it.  Ends
    of new edges are the stream's own business, as with any bulk load.
    """
    numbers = store.committed(spark, path)
    if numbers:
        marks = spark.read.schema(MARKED_DDL).parquet(*[f"{path}/log/txn={n}" for n in numbers])
        if not marks.where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty():
            return False
    if "seq" in changes.columns:
        last = Window.partitionBy("kind", "id").orderBy(F.desc("seq"))
        changes = changes.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    if changes.isEmpty():
        return False
    current = store.open_graph(spark, path)
    number = current.transactions + 1
    fs, torn = store._fs(spark, f"{path}/log/txn={number}")
    fs.delete(torn, True)  # of an attempt that failed: a complete one would have been counted
    order = F.when(F.col("op") == store.PUT, F.col("kind")).otherwise(3 - F.col("kind")).cast("tinyint")
    rows = changes.select(F.lit(number).cast("bigint").alias("txn"), order.alias("op_order"), "op", "kind", "id", "source", "target", "label", "props", "vecs")
    gone = changes.where((F.col("op") == store.DELETE) & (F.col("kind") == NODE)).select(F.col("id").alias("node"))
    own = changes.where(F.col("kind") == EDGE).select(F.col("id").alias("edge"))
    left = current.graph.adjacency.join(gone, "node", "left_semi").select("edge").distinct().join(own, "edge", "left_anti")
    tombs = left.select(F.lit(number).cast("bigint").alias("txn"), F.lit(store.ORDER[(store.DELETE, EDGE)]).cast("tinyint").alias("op_order"), F.lit(store.DELETE).alias("op"), F.lit(EDGE).cast("tinyint").alias("kind"), F.col("edge").alias("id"))
    full = rows.unionByName(tombs, allowMissingColumns=True)
    full.withColumns({"stream": F.lit(stream), "batch": F.lit(batch).cast("bigint")}).write.mode("errorifexists").parquet(f"{path}/log/txn={number}")
    return True


def follow(changes: DataFrame, path: str, checkpoint: str, stream: str = "mutations", **trigger) -> StreamingQuery:
    """Start appending a streaming frame of changes to a graph."""
    return changes.writeStream.foreachBatch(lambda df, batch: append(df.sparkSession, path, df, batch, stream) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
