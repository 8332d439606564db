"""Row numbers and files, without passing all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverspark.plans.workspace import partitions_for, write_table


def numbered(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """``df`` with dense numbers from 0 in an order that has no ties.

    Rows are dealt into ranges and sorted inside them; a number is the row's place in its
    range plus the rows of earlier ranges, of which the driver sees one count each.
    """
    placed = df.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = write_table(placed, "numbered")
    part = F.shiftright("__at", 33)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    rows, total = [], 0
    for p, n in counts:
        rows.append((p, total))
        total += n
    before = df.sparkSession.createDataFrame(rows, "__part bigint, __before bigint")  # one row a range
    row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + row).drop("__part", "__before", "__at")


def lines(spark, path: str) -> DataFrame:
    """(line, text) of a text file, lines numbered from 0 in their order.

    Files are split by Spark; a line's number comes from its file offset order, by counts of
    the splits before it.
    """
    placed = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")).withColumn("__at", F.monotonically_increasing_id())
    placed = write_table(placed, "lines")
    firsts = placed.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect()
    rows, total = [], 0
    for r in sorted(firsts, key=lambda r: (r["__file"], r["__start"])):
        rows.append((r["__file"], r["__start"], r["first"], total))
        total += r["n"]
    before = spark.createDataFrame(rows, "__file string, __start bigint, __first bigint, __before bigint")
    joined = placed.join(F.broadcast(before), ["__file", "__start"])
    return joined.select((F.col("__before") + F.col("__at") - F.col("__first")).alias("line"), F.col("value").alias("text"))
