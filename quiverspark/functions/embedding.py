"""Text embeddings: the deterministic hash embedder, pluggable ones, and a cache over texts."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverspark.model import InvalidArgument

#: 64-bit FNV-1a, and the weights of a token and of its byte trigrams.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
TOKEN_WEIGHT, TRIGRAM_WEIGHT = 1.0, 0.2
_MASK = (1 << 64) - 1
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


def ascii_lower(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and underscores."""
    return "".join(c if c.isalnum() or c == "_" else " " for c in text).split(" ")


def hash_embedding(text: str, dimension: int) -> np.ndarray:
    """Signed hashed counts of tokens and their byte trigrams, of length one."""
    v = np.zeros(dimension, dtype=np.float32)
    if not dimension:
        return v

    def add(data: bytes, weight: float) -> None:
        h = fnv1a(data)
        v[h % dimension] += np.float32(-weight if h >> 63 else weight)

    lowered = ascii_lower(text)
    words = [t.encode() for t in tokens(lowered) if t]
    for w in words:
        add(w, TOKEN_WEIGHT)
        for k in range(len(w) - 2):
            add(w[k : k + 3], TRIGRAM_WEIGHT)
    if not words:
        add(lowered.encode(), TOKEN_WEIGHT)
    norm = math.sqrt(float((v * v).sum()))
    if norm > np.finfo(np.float32).eps:
        return v / np.float32(norm)
    v[:] = 0
    v[0] = 1
    return v


def hash_embeddings(texts: Sequence[str], dimension: int) -> np.ndarray:
    """``hash_embedding`` of every text, a row each: the same sums in the same order, for all texts at once."""
    out = np.zeros((len(texts), dimension), dtype=np.float32)
    if not dimension or not len(texts):
        return out
    owner, pieces = [], []
    for i, text in enumerate(texts):
        lowered = ascii_lower(text)
        words = [t.encode() for t in tokens(lowered) if t]
        if not words:
            out[i] = hash_embedding(text, dimension)
        pieces += words
        owner += [i] * len(words)
    if not pieces:
        return out
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    prime, rows = np.uint64(FNV_PRIME), np.asarray(owner, dtype=np.int64)
    # whole tokens, a byte of each at a time
    h = np.full(len(pieces), FNV_OFFSET, dtype=np.uint64)
    at, k = np.arange(len(pieces)), 0
    while len(at):
        h[at] = (h[at] ^ data[starts[at] + k]) * prime
        k += 1
        at = at[lengths[at] > k]
    # byte trigrams that lie in one token
    inside = np.repeat(starts + lengths, lengths) - np.arange(len(data)) >= 3
    place = np.flatnonzero(inside)
    t = np.full(len(place), FNV_OFFSET, dtype=np.uint64)
    for j in range(3):
        t = (t ^ data[place + j]) * prime
    # a token is added before its trigrams, as one text alone is
    hashes, order = np.concatenate((h, t)), np.argsort(np.concatenate((2 * starts, 2 * place + 1)), kind="stable")
    weights = np.concatenate((np.full(len(h), TOKEN_WEIGHT, dtype=np.float32), np.full(len(t), TRIGRAM_WEIGHT, dtype=np.float32)))
    weights = np.where(hashes >> np.uint64(63), -weights, weights)
    owners = np.concatenate((rows, np.repeat(rows, lengths)[place]))
    cells = owners * dimension + (hashes % np.uint64(dimension)).astype(np.int64)
    np.add.at(out.reshape(-1), cells[order], weights[order])
    for i in np.unique(rows):
        norm = math.sqrt(float((out[i] * out[i]).sum()))
        if norm > np.finfo(np.float32).eps:
            out[i] /= np.float32(norm)
        else:
            out[i] = 0
            out[i, 0] = 1
    return out


def hash_embed(text: Column | str, dimension: int) -> Column:
    """The hash embedding of a text column, in Arrow batches; distinct texts of a batch are embedded once."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        codes, known = pd.factorize(texts)  # nulls are -1
        vectors = hash_embeddings(list(known), dimension)
        return pd.Series([vectors[c] if c >= 0 else None for c in codes], dtype=object)

    return embed(F.col(text) if isinstance(text, str) else text)


def remote_embedder(call: Callable[[Sequence[str], int], Sequence[Sequence[float]]], attempts: int = 3, pause: float = 0.35) -> Callable[[Sequence[str], int], np.ndarray]:
    """A batch embedder around a caller's own client, with retries and checks of what comes back."""

    def embed(texts: Sequence[str], dimension: int) -> np.ndarray:
        for attempt in range(attempts):
            try:
                found = np.asarray(call(texts, dimension), dtype=np.float32)
                break
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(pause * (1 << attempt))
        if found.shape != (len(texts), dimension):
            raise InvalidArgument(f"the embedder gave {found.shape} for {len(texts)} texts of {dimension}")
        if not np.isfinite(found).all():
            raise InvalidArgument("the embedder gave a number that is not finite")
        return found

    return embed


def embed_unique(rows: DataFrame, column: str, embed: Callable[[Sequence[str], int], np.ndarray] | None, dimension: int, batch: int = 256) -> DataFrame:
    """``rows`` with an ``embedding``; every distinct text is embedded once, whatever rows repeat it."""
    unique = rows.select(F.col(column).alias("__text")).where("__text IS NOT NULL").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = part["__text"].tolist()
                found = embed(texts, dimension) if embed is not None else hash_embeddings(texts, dimension)
                yield pd.DataFrame({"__text": texts, "embedding": [np.asarray(v, dtype=np.float32) for v in found]})

    known = unique.mapInPandas(run, "__text string, embedding array<float>")
    return rows.join(known, rows[column] == known["__text"], "left").drop("__text")
