"""Packing by power-of-two decomposition.

Each document becomes ids plus an end id and is cut, in order, into pieces whose
lengths are powers of two: as many of the longest as fit, then the binary digits of
the rest.  Every piece is a sequence of its own, so no sequence holds two documents
and none needs padding; sequences of one length form a bucket, and batches are drawn
from one bucket.

Cutting is a narrow map over the documents.  Only numbering needs the whole: dense
sequence ids come from one row per (length, task), so no task ever sees all pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverspark.llm import common
from quiverspark.plans.workspace import write_table

MAX_TOKENS = 2048
END_ID = 1
MEMO_WORDS = 400_000  # where other stages' memory is in the same executors
TOKENIZER = "byte_bpe_50k.json"

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("rank", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, task long, rank long, ids binary"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, longest first; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def decompose(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer: str = TOKENIZER, end_id: int = END_ID, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, task, rank, ids (little-endian uint32).

    A null or empty text is one piece that holds the end id alone; a text of any length is
    cut whole; pieces of one length are numbered by task and place, so there are no ties; a
    null doc_id stays null; repeated rows are documents of their own; extra columns are not read; an empty
    table gives no pieces.  ``task`` and ``rank`` number pieces of one length within the
    task that made them, and mean nothing until the frame has been written.  ``memo_words`` bounds the chunks that a
    process remembers, which costs memory and spares encoding; pieces do not depend on it.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, ranks = common.tokenizer(tokenizer, memo_words), TaskContext.get().partitionId(), {}
        for batch in common.narrow_batches(batches, 500):
            rows: list[tuple] = []
            for doc_id, data in zip(batch["doc_id"].to_pylist(), ids_of.encode(batch["text"].to_pylist()), strict=True):
                data += end
                n, at = len(data) // 4, 0
                for length in binary_lengths(n, max_tokens):
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    rows.append((doc_id, at, length, n, task, rank, data[4 * at : 4 * (at + length)]))
                    at += length
            if rows:
                yield common.batch_of(PIECES, list(map(list, zip(*rows, strict=True))))

    return common.id_and_text(docs).mapInArrow(cut, PIECES_DDL)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Add sequence_id (from 0 without gaps, bucket by bucket) and offset to *written* pieces.

    Works from one count per (length, task): a dozen lengths times the number of tasks.
    """
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("in_bucket", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = counts.groupBy("length").agg(F.sum("n").alias("bucket_n"))
    shorter = Window.partitionBy(F.lit(0)).orderBy("length").rowsBetween(Window.unboundedPreceding, -1)  # over one row a length
    bases = sizes.select("length", F.coalesce(F.sum("bucket_n").over(shorter), F.lit(0)).alias("base"))
    first = before.join(F.broadcast(bases), "length").select("length", "task", (F.col("base") + F.coalesce("in_bucket", F.lit(0))).alias("first"))
    return pieces.join(first, ["length", "task"]).withColumn("sequence_id", F.col("first") + F.col("rank")).withColumn("offset", F.lit(0).cast("long")).drop("first", "task", "rank")


def pack(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the packed sequences under ``path``, one folder per length, and return them numbered."""
    spark = docs.sparkSession
    decompose(docs, **options).write.partitionBy("length").option("compression", "zstd").parquet(path)
    return number_sequences(spark.read.schema(PIECES_DDL).parquet(path))


def pack_digests(docs: DataFrame, **options) -> DataFrame:
    """One row per piece with the unsigned crc32 of its ids in place of the ids; rows as by ``decompose``."""
    digests = decompose(docs, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    numbered = number_sequences(write_table(digests, "pieces"))
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_digests(common.table(spark, sf_dir, "documents"), memo_words=common.MEMO_WORDS)
