"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a worker process remembers; later ones are worked out for each batch (results do not depend on it).
MEMO_WORDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, for a session whose Arrow batches hold 2000 rows at most, unless it was told another number.

    Spark's 10000 rows suit numbers; with whole texts they fill tens of megabytes outside
    the heap for each batch in flight.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH_ROWS, "10000") == "10000":
        conf.set(BATCH_ROWS, "2000")
    return docs


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, with null texts as empty ones; other columns are not read."""
    text_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``: the contracts' held-out rule."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % folds


FILTER_BITS = 1 << 26
MAP_BITS = 1 << 15  # of one bitmap


def with_possible(rows: DataFrame, ids: DataFrame, n: int, column: str = "possible") -> DataFrame:
    """``rows`` and a column that is true wherever their doc_id may be among ``ids`` (doc_id, ``n`` distinct ones).

    Rows with long texts need not move to be told apart: they stay where they lie and see a bit for the hash of
    their id, in bitmaps of 8 MB in all at most, whatever the number of ids.  A true may be wrong, for one
    row in 16 or so as long as there are no more than 4 million ids and for more of them beyond, so an exact join
    has to follow; a false never is.  A null doc_id gives false.
    """
    bits = max(MAP_BITS, min(FILTER_BITS, 1 << (16 * max(1, n) - 1).bit_length()))
    taken = {c.lower() for c in (*rows.columns, column)}
    number, bitmap = (next(c for k in itertools.count() if (c := f"{name}{k}") not in taken) for name in ("number", "bitmap"))
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("possible")), F.lit(bits))
    bit = hashed % MAP_BITS
    maps = ids.where(F.col("doc_id").isNotNull()).select(F.floor(hashed / MAP_BITS).alias(number), bit.alias(bitmap))
    maps = maps.repartition(number).groupBy(number).agg(F.bitmap_construct_agg(bitmap).alias(bitmap))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    told = F.col("doc_id").isNotNull() & F.coalesce(F.bit_get(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn(number, F.floor(hashed / MAP_BITS)).join(F.broadcast(maps), number, "left").select(*[F.col(f"`{c.replace('`', '``')}`") for c in rows.columns], told.alias(column))


def narrow_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that a worker holds few texts as Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists_of(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from one flat array and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


class TokenIds:
    """Ids of whole texts by the tokenizers library, as little-endian uint32 bytes.

    Both vocabularies cut a text at every single space or line feed that stands between
    other characters (no pre-token reaches over that place), so a text is split there and
    each chunk is encoded once per process and looked up afterwards.  New chunks are given
    to the library many at a time, with a separator between them whose id no chunk has.
    A text with any other white space, or with more of it at once, goes to the library
    whole.  Special-token strings inside texts are ordinary text, as the tokenizers' own
    instructions (README.md beside the files) set the library up: an id that ends documents
    must not come out of a document's text.
    """

    #: White space other than space and line feed, by the widest of the engines' definitions.
    ODD_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    JOINED = 64

    def __init__(self, file: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if os.path.isabs(file) else public_tokenizers.path(file))
        self.tokenizer.encode_special_tokens = True
        self.drops_space = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.mark = "^" if self.drops_space else "\n"
        self.separator = f" {self.mark} " if self.drops_space else self.mark
        mark = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = mark[0] if len(mark) == 1 else None
        self.memo: dict[str, bytes] = {}
        self.memo_words = memo_words

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, text: str) -> list[str] | None:
        """The text's chunks, or None where it must be encoded whole."""
        if not text.isascii():
            if any(c in text for c in self.ODD_SPACE):
                return None
        elif any(c in text for c in self.ODD_SPACE[:8]):
            return None
        if self.drops_space:
            return (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")
        if text[0] in " \n" or "  " in text or " \n" in text or "\n\n" in text:
            return None
        return f" \n{text}".replace("\n", " \n").split(" ")[2:]

    def _learn(self, chunks: list[str]) -> None:
        joined, alone = [], []
        for c in chunks:
            (alone if not c or self.mark_id is None or self.mark in c else joined).append(c)
        before = "" if self.drops_space else " "
        parts = [joined[at : at + self.JOINED] for at in range(0, len(joined), self.JOINED)]
        together = [self.separator.join([before + c for c in part]) for part in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(together, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            if len(ends) != len(part):
                raise ValueError("a chunk holds the separator's id")
            data, at = ids.tobytes(), 0
            for c, end in zip(part, ends.tolist(), strict=True):
                self.memo[c] = data[4 * at : 4 * end]
                at = end + 1
        self.memo.update(zip(alone, self._whole([c if c[:1] == "\n" else before + c for c in alone]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._chunks(t) if t else [] for t in texts]
        new: set[str] = set()
        for chunks in split:
            if chunks:
                new.update(chunks)
        new = new.difference(self.memo)  # not difference_update, which would walk through the whole memo
        if new:
            self._learn(list(new))
        memo = self.memo
        whole = iter(self._whole([t for t, c in zip(texts, split, strict=True) if c is None]))
        skip = 0 if self.drops_space else 4  # the line feed that was put before the text
        out = [next(whole) if c is None else b"".join(map(memo.__getitem__, c))[skip:] for c in split]
        if len(memo) > self.memo_words:
            for c in new:
                del memo[c]
        return out


_HELD: list = [None, None, None]


def give_back() -> None:
    """Return freed memory to the system: allocators keep it otherwise, for as long as a worker lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def per_process(kind: str, version: str, make: Callable):
    """The object of a kind and version that a worker process holds.

    A process holds one at a time: workers outlive stages, and what earlier stages have
    remembered would add up over a pipeline.  Each call, one a task, also gives back what
    earlier tasks have freed.
    """
    same = _HELD[:2] == [kind, version]
    if not same:
        _HELD[:] = [None, None, None]
    give_back()
    if not same:
        _HELD[:] = [kind, version, make()]
    return _HELD[2]


def hold_nothing() -> None:
    """For tasks that remember nothing: lets go of what earlier stages have left in the process."""
    per_process("nothing", "", lambda: None)


def tokenizer(file: str, memo_words: int = MEMO_WORDS) -> TokenIds:
    return per_process("ids", f"{file} {memo_words}", lambda: TokenIds(file, memo_words))
