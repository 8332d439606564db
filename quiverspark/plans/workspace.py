"""Shared working tables: lineage is cut by writing Parquet where all executors can read it.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where a
session has none (unit tests, a laptop) and only there, a local temporary folder
is made, which is right because driver and executors then share one machine.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for working tables, made known to ``DataFrame.checkpoint`` too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="quiverspark-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK[app])
    return _LOCAL_FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quiverspark/{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads it back (recovers from lost executors)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``write_table``, and aggregates of the rows that were taken while they were written."""
    seen = Observation()
    observed = df.observe(seen, *[c.alias(k) for k, c in measures.items()])
    return write_table(observed, name), seen.get


def write_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``write_table``, and how many rows were written, without reading them again."""
    table, seen = write_observed(df, name, n=F.count(F.lit(1)))
    return table, seen["n"]


class Seen:
    """What earlier layers of a traversal have met, for anti-joins.

    With ``recent`` the last two layers are enough.  Otherwise the layers are a union that is
    written anew as one table each time it has doubled its parts, so plans stay short and all
    the writing together is a small multiple of what was met.
    """

    LAYERS = 8

    def __init__(self, first: DataFrame, recent: bool = False):
        self.recent, self.layers, self.limit = recent, [first], self.LAYERS

    @property
    def frame(self) -> DataFrame:
        out = self.layers[0]
        for layer in self.layers[1:]:
            out = out.unionByName(layer)
        return out

    def add(self, layer: DataFrame) -> None:
        self.layers.append(layer)
        if self.recent:
            self.layers = self.layers[-2:]
        elif len(self.layers) > self.limit:
            self.layers = [write_table(self.frame, "seen")]


def write_bucketed(df: DataFrame, name: str, column: str, buckets: int, dealt: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` bucketed and sorted by a column, so that joins on it in later rounds shuffle the other side only.

    Returns the frame and the name of its table, which the caller drops when done.  ``dealt`` says that the
    rows were dealt out by the column already, into as many partitions.
    """
    spark = df.sparkSession
    table = f"quiverspark_{name}_{uuid.uuid4().hex}"
    writer = (df if dealt else df.repartition(buckets, column)).write.bucketBy(buckets, column).sortBy(column)
    writer.option("path", new_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table), table


def plan_bytes(df: DataFrame) -> int:
    """Bytes of what a frame's plan reads: file sizes for scans, nothing where the size is unknown.

    Leaves are summed, as estimates above joins are products and say little.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """A partition count that follows the input's size, at least the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, min(1 << 20, math.ceil(plan_bytes(df) / bytes_each)))


def drop_table(df: DataFrame) -> None:
    """Delete the files of a working table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quiverspark/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
