"""Token-id store: raw id payloads in shards, found through a minimal perfect hash index.

Format, a folder with three Parquet tables (so any store Spark reaches will do):

* ``payload/shard=N``: one row per block, ``block, first, doc_ids, copies, offsets,
  lengths, width, ids``.  ``ids`` are the raw little-endian ids of the block's documents,
  ``width`` bytes each (2 where the vocabulary allows, else 4); ``offsets`` and
  ``lengths`` count ids; ``first`` counts the shard's ids before the block.  Shards
  follow ascending doc_id.
* ``index/part=N``: 64 segments of about 4096 keys, ``segment, keys, sizes, bits,
  prints, places``.  ``bits`` holds the levels of a minimal perfect hash (a key lives in
  the first level where no other key took its bit; its slot is the number of set bits
  before it), ``prints`` a 32-bit fingerprint per slot and ``places`` the slot's shard,
  block, offset and length.  Keys themselves are not stored: a lookup costs one probe per
  level (1.6 on average) and a foreign key is refused by its fingerprint, but for one in
  2**32.
* ``meta``: one row, the number of segments.

A key's hash names its segment and so the index folder, its slot names the shard and so the
payload folder: a lookup of few keys opens these folders by their paths and lists no table.

A key is (doc_id, copy), where copy counts earlier rows of the same doc_id.  Rows of one
doc_id may spread over shards; ``copies`` in a block count from the shard's first such row,
and ``directory`` adds those of earlier shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark.llm import common
from quiverspark.plans.workspace import new_path, partitions_for
from quiverspark.sources.store import exists

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 20
SEGMENT_KEYS = 4096
LOAD = 1.6
SEGMENTS_A_PART = 64
FEW_KEYS = 1000  # keys up to which a lookup opens folders by their paths; more are joined

PAYLOAD_DDL = "shard int, block int, first long, doc_ids array<long>, copies array<int>, offsets array<long>, lengths array<long>, width int, ids binary"
PAYLOAD = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary())]
)
INDEX_DDL = "part long, segment long, keys int, sizes array<int>, bits binary, prints binary, places binary"
PLACE_DDL = "doc_id long, copy int, shard int, block int, offset long, n_tokens long"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys, one independent-looking function per seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def key_hashes(doc_ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return _mix(np.asarray(doc_ids, dtype=np.int64).view(np.uint64), 1) + _mix(np.asarray(copies, dtype=np.int64).view(np.uint64), 2)


@dataclass
class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys, as levels of bits."""

    sizes: list[int]
    bits: np.ndarray  # of bool, all levels after one another

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) > 64:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(1, math.ceil(LOAD * len(left)))
            at = (_mix(left, 10 + len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has it."""
        found, rank, base = np.full(len(keys), -1, dtype=np.int64), np.cumsum(self.bits), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mix(keys, 10 + level) % np.uint64(size)).astype(np.int64)
            hit = (found < 0) & self.bits[at]
            found[hit] = rank[at[hit]] - 1
            base += size
        return found


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Payload blocks in ascending doc_id order; one range shuffle of the texts, then a narrow encode.

    Ranges also follow a hash of the text and the row's place, so rows that share a doc_id, or
    have none, are no single task's.
    """
    end = np.array([end_id], dtype="<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, shard, block, first = common.tokenizer(tokenizer), TaskContext.get().partitionId(), 0, 0
        width = 2 if max(ids_of.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        last, copy = object(), 0
        doc_ids, copies, lengths, parts, held = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])).tolist()
            return common.batch_of(PAYLOAD, [[shard], [block], [first], [doc_ids], [copies], [offsets], [lengths], [width], [b"".join(parts)]])

        for batch in common.narrow_batches(batches, 500):
            for doc_id, data in zip(batch["doc_id"].to_pylist(), ids_of.encode(batch["text"].to_pylist()), strict=True):
                copy = copy + 1 if doc_id == last else 0
                last = doc_id
                ids = np.concatenate((np.frombuffer(data, dtype="<u4"), end))
                doc_ids.append(doc_id)
                copies.append(copy)
                lengths.append(len(ids))
                parts.append(ids.astype(f"<u{width}").tobytes())
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield row()
                    block, first = block + 1, first + held
                    doc_ids, copies, lengths, parts, held = [], [], [], [], 0
        if doc_ids:
            yield row()

    texts = common.id_and_text(docs)
    order = ["doc_id", "content", "place"]
    placed = texts.select("*", F.xxhash64("text").alias("content"), F.monotonically_increasing_id().alias("place"))
    return placed.repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, PAYLOAD_DDL)


def _segment(segments: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("copy")), F.lit(segments))


def _part(segment: Column) -> Column:
    return F.floor(segment / SEGMENTS_A_PART)


def _asked(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("int").alias("copy")).distinct()


def _null_as_key(doc_ids: pd.Series) -> np.ndarray:
    return doc_ids.fillna(-(1 << 63)).to_numpy(dtype=np.int64)


class TokenStore:
    """A written store; ``write`` makes one, ``scan`` and ``lookup`` read it."""

    def __init__(self, spark: SparkSession, path: str, payload: DataFrame | None = None):
        self.spark, self.path = spark, path
        self.payload = spark.read.schema(PAYLOAD_DDL).parquet(f"{path}/payload") if payload is None else payload

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> TokenStore:
        """Encode whole texts, write payload and index.

        A null or empty text is its end id alone; a null doc_id sorts first and is a key
        like any other; rows that repeat a doc_id are stored in the order of a hash of their
        texts, then of their places, as copies 0, 1, ...; a text of any length is one
        document of one block, which holds more than its usual ids if it must; extra columns
        are not read; an empty table gives an empty store.
        """
        encode_blocks(docs, tokenizer, end_id).write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/payload")
        spark = docs.sparkSession
        store = cls(spark, path)
        keys = store.directory().select("doc_id", "copy", "shard", "block", "offset", "n_tokens")
        segments = max(1, (store.payload.agg(F.sum(F.size("doc_ids"))).first()[0] or 0) // SEGMENT_KEYS)
        spark.createDataFrame([(segments,)], "segments long").write.parquet(f"{path}/meta")

        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            hashes = key_hashes(_null_as_key(rows["doc_id"]), rows["copy"].to_numpy())
            perfect = PerfectHash.build(hashes)
            slots = perfect.slots(hashes)
            prints, places = np.zeros(len(rows), dtype="<u4"), np.zeros((len(rows), 4), dtype="<i8")
            prints[slots] = (_mix(hashes, 3) & np.uint64(0xFFFFFFFF)).astype("<u4")
            places[slots] = rows[["shard", "block", "offset", "n_tokens"]].to_numpy(dtype="<i8")
            return pd.DataFrame({"part": [key[0]], "segment": [key[1]], "keys": [len(rows)], "sizes": [perfect.sizes], "bits": [np.packbits(perfect.bits).tobytes()], "prints": [prints.tobytes()], "places": [places.tobytes()]})

        # dealt by part, which serves the grouping by part and segment too
        dealt = keys.withColumn("segment", _segment(segments)).withColumn("part", _part(F.col("segment"))).repartition("part")
        dealt.groupBy("part", "segment").applyInPandas(build, INDEX_DDL).write.partitionBy("part").parquet(f"{path}/index")
        return store

    def segments(self) -> int:
        return self.spark.read.schema("segments long").parquet(f"{self.path}/meta").first()[0]

    def _folders(self, table: str, column: str, values: list[int], ddl: str) -> DataFrame:
        """Rows of some folders of a table, opened by their paths."""
        paths = [p for v in values if exists(self.spark, p := f"{self.path}/{table}/{column}={v}")]
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def directory(self) -> DataFrame:
        """Header rows of the payload, one per document, without reading ids."""
        each = F.explode(F.arrays_zip("doc_ids", "copies", "offsets", "lengths")).alias("x")
        headers = self.payload.join(F.broadcast(self.shard_starts()), "shard").select("shard", "block", "first", "first_id", "earlier", each)
        copy = F.col("x.copies") + F.when(F.col("x.doc_ids").eqNullSafe(F.col("first_id")), F.col("earlier")).otherwise(0)
        return headers.select(F.col("x.doc_ids").alias("doc_id"), copy.cast("int").alias("copy"), "shard", "block", "first", F.col("x.offsets").alias("offset"), F.col("x.lengths").alias("n_tokens"))

    def locate(self, keys: DataFrame, index: DataFrame | None = None) -> DataFrame:
        """Places of keys (doc_id, copy) by the index; keys it does not hold are left out."""
        segments = self.segments()
        if index is None:
            index = self.spark.read.schema(INDEX_DDL).parquet(f"{self.path}/index")

        def probe(key: tuple, wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(wanted) or not len(held):
                return pd.DataFrame({c.split()[0]: [] for c in PLACE_DDL.split(", ")})
            row = held.iloc[0]
            bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=int(sum(row["sizes"]))).astype(bool)
            hashes = key_hashes(_null_as_key(wanted["doc_id"]), wanted["copy"].to_numpy())
            slots = PerfectHash([int(s) for s in row["sizes"]], bits).slots(hashes)
            prints, places = np.frombuffer(row["prints"], dtype="<u4"), np.frombuffer(row["places"], dtype="<i8").reshape(-1, 4)
            good = (slots >= 0) & (prints[np.maximum(slots, 0)] == (_mix(hashes, 3) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            out = wanted.loc[good, ["doc_id", "copy"]].reset_index(drop=True)
            for k, name in enumerate(("shard", "block", "offset", "n_tokens")):
                out[name] = places[slots[good], k]
            return out

        asked = _asked(keys).withColumn("segment", _segment(segments))
        return asked.groupBy("segment").cogroup(index.drop("part").groupBy("segment")).applyInPandas(probe, PLACE_DDL)

    def slices(self) -> DataFrame:
        """Each document's ids as little-endian uint32, read block by block: shard, block, offset, start, ids."""
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("start_in_shard", pa.int64()), ("ids", pa.binary())])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.narrow_batches(batches, 1):
                shard, block, first, width = (batch[c][0].as_py() for c in ("shard", "block", "first", "width"))
                offsets, lengths = batch["offsets"][0].as_py(), batch["lengths"][0].as_py()
                ids = np.frombuffer(batch["ids"][0].as_buffer(), dtype=f"<u{width}").astype("<u4")
                for at in range(0, len(offsets), 500):
                    part = list(zip(offsets[at : at + 500], lengths[at : at + 500], strict=True))
                    yield common.batch_of(schema, [[shard] * len(part), [block] * len(part), [o for o, _ in part], [first + o for o, _ in part], [ids[o : o + n].tobytes() for o, n in part]])

        blocks = self.payload.select("shard", "block", "first", "offsets", "lengths", "width", "ids")
        return blocks.mapInArrow(cut, "shard int, block int, offset long, start_in_shard long, ids binary")

    def shard_starts(self) -> DataFrame:
        """Ids before each shard, its first doc_id, and rows of that one in earlier shards; one row per shard
        passes the driver, whatever the corpus holds."""
        each = self.payload.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.col("doc_ids")[0].alias("first_id"), F.element_at("doc_ids", -1).alias("last_id"), F.element_at("copies", -1).alias("last_copy"))
        ends = each.groupBy("shard").agg(F.sum("n").alias("n"), F.min(F.struct("block", "first_id")).alias("a"), F.max(F.struct("block", "last_id", "last_copy")).alias("z"))
        rows, total, last, copies = [], 0, None, 0
        for r in sorted(ends.collect(), key=lambda r: r["shard"]):
            earlier = copies if rows and r["a"]["first_id"] == last else 0
            rows.append((r["shard"], total, r["a"]["first_id"], earlier))
            total += r["n"]
            copies = r["z"]["last_copy"] + 1 + (earlier if r["z"]["last_id"] == r["a"]["first_id"] else 0)
            last = r["z"]["last_id"]
        return self.spark.createDataFrame(rows, "shard int, before long, first_id long, earlier int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """doc_id, copy and ids of the asked keys: index first, then only the blocks it names.

        Up to ``FEW_KEYS`` keys cost the folders of their segments and shards, whatever the
        store holds; more are joined with the whole index and payload.
        """
        few = _asked(keys).withColumn("part", _part(_segment(self.segments()))).limit(FEW_KEYS + 1).collect()
        if len(few) > FEW_KEYS:
            places = self.locate(keys)
            blocks = self.payload.join(places.select("shard", "block").distinct(), ["shard", "block"], "left_semi")
        else:
            asked = self.spark.createDataFrame([(r["doc_id"], r["copy"]) for r in few], "doc_id long, copy int")
            found = self.locate(asked, self._folders("index", "part", sorted({r["part"] for r in few}), INDEX_DDL)).collect()
            places = self.spark.createDataFrame(found, PLACE_DDL)
            payload = self._folders("payload", "shard", sorted({r["shard"] for r in found}), PAYLOAD_DDL)
            blocks = payload.where(F.struct("shard", "block").isin([F.struct(F.lit(a), F.lit(b)) for a, b in sorted({(r["shard"], r["block"]) for r in found})])) if found else payload
        held = TokenStore(self.spark, self.path, blocks)
        return places.join(held.slices(), ["shard", "block", "offset"]).select("doc_id", "copy", "n_tokens", "ids")

    def digests(self) -> DataFrame:
        """doc_id, copy, start, n_tokens and ids_crc32 of every stored document, read back through the index."""
        places = self.locate(self.directory().select("doc_id", "copy"))
        read = self.slices().withColumn("ids_crc32", F.crc32("ids")).withColumn("read_tokens", F.length("ids") / 4).drop("ids")
        read = read.join(F.broadcast(self.shard_starts().select("shard", "before")), "shard")
        found = places.join(read, ["shard", "block", "offset"]).where(F.col("n_tokens") == F.col("read_tokens"))
        return found.select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32", "copy")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back through the index."""
    return TokenStore.write(common.table(spark, sf_dir, "documents"), new_path(spark, "token_store")).digests()
