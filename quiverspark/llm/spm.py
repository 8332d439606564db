"""SentencePiece encoding and decoding by a streaming Viterbi search.

Pieces and scores come from a model file; the best segmentation is the one with the
highest sum of scores (the library's unigram rule; on a model that was trained as BPE it
is the same pieces under that rule, not the merge order).  Text streams through a window:
the states that can still matter are the newest boundary and those from which a piece may
yet be completed, none farther back than the longest piece.  Whenever all their backpointer
paths meet at one boundary, everything before it is final, its ids are committed and the
window forgets it.  Memory is bounded by the distance between such boundaries, whatever the
text's length.

Where no piece holds the space mark after another character, every run of marks begins at
a boundary that all paths share; a text is then searched stretch by stretch, and the ids of
a stretch are kept for its next occurrence in the process.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark.llm import common

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
NO_CHOICE = -1e8  # scores below it keep a piece from ever being chosen, and say nothing about unknown characters
CHECK_EVERY = 32
MEMO_STRETCHES = 300_000


class Pieces:
    """Vocabulary of a model file, with encoding and decoding."""

    def __init__(self, file: str):
        import public_tokenizers
        import sentencepiece

        path = file if "/" in file else public_tokenizers.path(file)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.names[i]: (model.get_score(i), i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.unknown_score = min(s for s, _ in self.score.values() if s > NO_CHOICE) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.score))
        self.trie: dict = {}
        for piece, known in self.score.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = known
        self.by_stretch = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.memo: dict[str, bytes] = {}

    def _spelt(self, text: str) -> list[int]:
        """Ids of a character that no piece holds."""
        return [self.bytes[b] for b in text.encode()] if len(self.byte_of) == 256 else [self.unknown]

    def stream(self, characters: Iterable[str]) -> Iterator[list[int]]:
        """Ids in portions, each final when it is given out; ``characters`` may come in pieces of any length."""
        trie, unknown = self.trie, self.unknown_score
        window, best, back = [], [0.0], [(0, None)]  # positions count from the last committed boundary
        check = CHECK_EVERY  # where paths are looked at next: later and later while they do not meet
        open_: list[tuple[int, dict]] = []  # where pieces begin that the text may yet complete, earliest first
        for part in characters:
            for c in part:
                at = len(window)
                top, way, single, still = -np.inf, (at, None), False, []
                open_.append((at, trie))
                for start, node in open_:  # of equal paths the one with the longer last piece
                    node = node.get(c)
                    if node is not None:
                        still.append((start, node))
                        known = node.get(None)
                        if known is not None:
                            single = start == at
                            if best[start] + known[0] > top:
                                top, way = best[start] + known[0], (start, known[1])
                if not single and best[at] + unknown > top:
                    top, way = best[at] + unknown, (at, None)
                window.append(c)
                best.append(top)
                back.append(way)
                open_ = still
                if at + 1 == check:
                    check += max(CHECK_EVERY, check // 2)
                    live = {start for start, _ in open_}
                    live.add(at + 1)
                    while len(live) > 1:
                        last = max(live)
                        live.discard(last)
                        live.add(back[last][0])
                    boundary = live.pop()
                    if boundary:
                        yield self._path(window, back, boundary)
                        base = best[boundary]
                        window, best = window[boundary:], [b - base for b in best[boundary:]]
                        back = [(0, None)] + [(b - boundary, i) for b, i in back[boundary + 1 :]]
                        open_ = [(start - boundary, node) for start, node in open_]
                        check = len(window) + CHECK_EVERY
        if window:
            yield self._path(window, back, len(window))

    def _path(self, window: list[str], back: list, end: int) -> list[int]:
        steps = []
        while end > 0:
            start, piece = back[end]
            steps.append([piece] if piece is not None else self._spelt(window[start]))
            end = start
        return [i for step in reversed(steps) for i in step]

    STRETCHES = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32; one mark is put before the text, spaces become marks."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        stretches = self.STRETCHES.findall(marked) if self.by_stretch else [marked]
        memo = self.memo
        new = set(stretches).difference(memo)
        for s in new:
            memo[s] = b"".join(array("I", ids).tobytes() for ids in self.stream([s]))
        out = b"".join(map(memo.__getitem__, stretches))
        if len(memo) > MEMO_STRETCHES or not self.by_stretch:
            for s in new:
                del memo[s]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids from ``encode``; control pieces and ids outside the vocabulary are left out."""
        parts: list[bytes] = []
        for i in ids:
            if i in self.byte_of:
                parts.append(bytes([self.byte_of[i]]))
            elif 0 <= i < len(self.names) and self.names[i] in self.score:
                parts.append(self.names[i].encode())
        text = b"".join(parts).decode("utf-8", errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def pieces(file: str = MODEL) -> Pieces:
    return common.per_process("pieces", file, lambda: Pieces(file))


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (little-endian uint32) of every row.

    A null or empty text has no ids; a text of any length is encoded whole; of equally good
    segmentations the one whose pieces are longer at the end is taken; a null doc_id stays
    null; repeated rows are encoded alike; extra columns are not read; an empty table gives no
    rows.  A space mark inside a text is indistinguishable from a space, as in the format itself.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in common.narrow_batches(batches):
            yield common.batch_of(schema, [batch["doc_id"], [vocabulary.encode(t) for t in batch["text"].to_pylist()]])

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def decoded(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in common.narrow_batches(batches):
            yield common.batch_of(schema, [batch["doc_id"], [vocabulary.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in batch["ids"].to_pylist()]])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("text", pa.string()), ("same", pa.bool_())])


def round_trips(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, the text that they decode to, and whether it is the row's own text.

    Rows are treated as by ``encoded``; a null text decodes to the empty one, which counts as the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in common.narrow_batches(batches, 500):
            texts = batch["text"].to_pylist()
            data = [vocabulary.encode(t) for t in texts]
            back = [vocabulary.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in data]
            yield common.batch_of(ROUND_TRIP, [batch["doc_id"], [len(x) // 4 for x in data], data, back, [a == b for a, b in zip(texts, back, strict=True)]])

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, n_ids long, ids binary, text string, same boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, the digest of the text that they decode to, and whether that is the document's."""
    read = round_trips(common.table(spark, sf_dir, "documents"))
    return read.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"), F.col("same").alias("decoded_equals_text"))
