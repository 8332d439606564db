"""Near-duplicate detection with b-bit MinHash.

1. Each text becomes the set of its 5-word shingles (64-bit hashes); a narrow map gives its
   size, a 128-bit digest of the set, 120 minima's low 4 bits packed in 64 bytes, and 24
   band keys of 5 full minima each.
2. Texts with one set are one class; its representative is the smallest doc_id.  Copies
   are never compared with each other.
3. Classes that share a band key meet in a bucket.  A bucket of more than 256 classes is
   contracted first: each class goes to a block of one of its buckets, the most crowded,
   and is linked there exactly; then a few heads of each group so found are linked with
   heads of others, first in that bucket, then, for groups of some size, in all crowded
   ones, until groups no longer fall in number.  m near copies cost a multiple of m rows
   and end as one group and a few classes beside it.
4. What is left to compare are pairs whose groups differ.  A bucket of one group is done; in
   a small one all classes meet; in a crowded one the classes outside its largest group, in
   blocks, meet each other and the blocks of that group, so members of one group are not
   compared again.  Similarity is estimated from the packed bits (corrected for the 1 in 16
   chance that bits agree by accident) and only *classes with a likely partner* are kept, at
   most one row per class and pair of blocks.  A pair that shares an earlier band is left to
   that band.
5. Shingle sets of the kept classes are made again from their whole texts, and links are
   confirmed on them exactly; each task gives a spanning forest of its links, not all pairs.
6. Components of the forests give the groups.

The work inside a crowded bucket still grows with the square of the classes that stay outside
its largest group: texts that share a band, five full minima, but are not linked.

A pair at similarity 0.85 shares a band with probability 1 - 7e-7 (1 - (1 - 0.85**5)**24),
one at 0.80 with 1 - 7e-5, and the estimate's cut lies 5.3 and 4.7 standard errors below
those thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverspark.llm import common
from quiverspark.operators.components import connected_components
from quiverspark.plans.workspace import drop_table, partitions_for, write_counted, write_observed, write_table

WORDS = 5
BANDS, ROWS, BITS = 24, 5, 4
HASHES = BANDS * ROWS
THRESHOLD = 85
MARGIN = 0.18
BLOCK = 256
HEADS, MEMBERS, CONTRACTIONS = 4, 16, 8
PAIRS_AT_ONCE = 1 << 16
MEMO_WORDS = 400_000

_U64 = np.uint64
_SEEDS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, size=2 * HASHES, dtype=np.uint64)
_XOR = (_SEEDS[:HASHES] >> _U64(7)).astype(np.uint32)
_MUL = (_SEEDS[HASHES:] >> _U64(5)).astype(np.uint32) | np.uint32(1)
_STEP = [_U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]

SHINGLED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64()))])
SHINGLED_DDL = "doc_id long, n_shingles long, d1 long, d2 long, bits binary, bands array<long>"


class Shingler:
    """Distinct shingle hashes of a text, ascending."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.words, len(words))
        out = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * _STEP[k % len(_STEP)]
            out ^= out >> _U64(29)
        return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 120 minima of a non-empty set."""
    x = (shingles >> _U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        part = np.bitwise_xor(_XOR[:, None], x[None, at : at + 1024])
        part *= _MUL[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def pack_bits(best: np.ndarray) -> np.ndarray:
    """Low 4 bits of each minimum, two a byte, in 64 bytes."""
    low = np.zeros(128, dtype=np.uint8)
    low[:HASHES] = best & np.uint32(15)
    return low[0::2] | low[1::2] << 4


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * _STEP[k]
        key ^= key >> _U64(31)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of paired rows of packed bits (n x 8 uint64), corrected for accidental agreement."""
    x = a ^ b
    x |= x >> _U64(2)
    x |= x >> _U64(1)
    differ = np.bitwise_count(x & _U64(0x1111111111111111)).sum(axis=1)
    accident = 1 / (1 << BITS)
    return (1 - differ / HASHES - accident) / (1 - accident)


def shingled(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document with the size, digest, packed bits and band keys of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = common.per_process("shingler", str(words), lambda: Shingler(words))
        for batch in common.narrow_batches(batches, 2000):
            sizes, digests, bits, bands, empty = [], [], [], [], np.zeros(0, dtype=np.int64)
            for text in batch["text"]:
                s = shingles_of(text.as_py())
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                best = minima(s) if len(s) else None
                bits.append(pack_bits(best).tobytes() if len(s) else b"")
                bands.append(band_keys(best) if len(s) else empty)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            flat = np.concatenate(bands) if bands else empty
            yield common.batch_of(SHINGLED, [batch["doc_id"], sizes, halves[:, 0], halves[:, 1], bits, common.lists_of(flat, np.array([len(b) for b in bands]), pa.int64())])

    return common.id_and_text(docs).mapInArrow(run, SHINGLED_DDL)


def _in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; a group that spans batches is joined up."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for k in keys:
            column = batch[k].to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        # rows of the batch's last group stand at its end, as the input is sorted
        last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if last or not held or any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys):
            if last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            elif held:
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _spans(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        column = table[k].to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _block_pairs(spans: np.ndarray, block: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare: within a group where its two blocks are one, else across them; in bounded portions."""
    starts, sizes = spans[:-1], np.diff(spans)
    for size in np.unique(sizes):
        if size < 2:
            continue
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(at), step):
            for c in range(0, len(i), PAIRS_AT_ONCE):
                a = (at[k : k + step, None] + i[None, c : c + PAIRS_AT_ONCE]).ravel()
                b = (at[k : k + step, None] + j[None, c : c + PAIRS_AT_ONCE]).ravel()
                keep = (p[a] == q[a]) | (block[a] != block[b])
                yield a[keep], b[keep]


KEYS = ["band", "key", "p", "q"]


def likely(buckets: DataFrame, cut: float, threshold: int) -> DataFrame:
    """(band, key, p, q, rep, comp, block) of classes with a likely partner of another group in a pair of blocks."""
    schema = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("block", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_groups(batches, KEYS):
            table = table.combine_chunks()
            block, p, q, band, n, comp = (table[c].to_numpy() for c in ("block", "p", "q", "band", "n_shingles", "comp"))
            bits = np.frombuffer(b"".join(table["bits"].to_pylist()), dtype="<u8").reshape(-1, 8)
            bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            flagged = np.zeros(table.num_rows, dtype=bool)
            for a, b in _block_pairs(_spans(table, KEYS), block, p, q):
                good = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]))
                a, b = a[good], b[good]
                good = estimate(bits[a], bits[b]) >= cut
                a, b = a[good], b[good]
                good = (bands[a] == bands[b]).argmax(axis=1) == band[a]
                flagged[a[good]] = True
                flagged[b[good]] = True
            if flagged.any():
                yield common.batch_of(schema, [table[c].to_numpy()[flagged] for c in (*KEYS, "rep", "comp", "block")])

    return buckets.mapInArrow(run, "band int, key long, p int, q int, rep long, comp long, block int")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


DENSE_CELLS = 1 << 24


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some sets with others, by a product of 0/1 matrices over the shingles in portions."""
    both = np.concatenate((rows, columns))
    owner = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
    words, at = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True)
    total = np.zeros((len(rows), len(columns)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    step = max(1, DENSE_CELLS // len(both))
    for first in range(0, len(words), step):
        lo, hi = np.searchsorted(at, (first, first + step))
        x = np.zeros((len(both), min(step, len(words) - first)), dtype=np.float32)
        x[owner[lo:hi], at[lo:hi] - first] = 1
        total += x[: len(rows)] @ x[len(rows) :].T
    return total


def _links(rep: list[int], comp: list[int], sets: list[np.ndarray], block: np.ndarray, one: bool, threshold: int, forest: _Forest) -> list[tuple[int, int]]:
    """Exact links that join groups of the forest: among all rows if ``one``, else across their two blocks."""
    found = []
    size = np.array([len(s) for s in sets])

    def take(a: int, b: int) -> None:
        if forest.join(comp[a], comp[b]):
            found.append((min(rep[a], rep[b]), max(rep[a], rep[b])))

    if len(sets) <= 8:
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                if (one or block[a] != block[b]) and rep[a] != rep[b]:
                    small, large = sorted((sets[a], sets[b]), key=len)
                    if 100 * len(small) >= threshold * len(large) and forest.root(comp[a]) != forest.root(comp[b]):
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        shared = int((large[at] == small).sum())
                        if 100 * shared >= threshold * (len(small) + len(large) - shared):
                            take(a, b)
        return found
    everyone = np.arange(len(sets))
    side = everyone if one else np.flatnonzero(block == block.min())
    other = everyone if one else np.flatnonzero(block != block.min())
    for at in range(0, len(side), 128):
        rows = side[at : at + 128]
        shared = _overlaps(sets, rows, other)
        linked = 100 * shared >= threshold * (size[rows][:, None] + size[other][None, :] - shared)
        for a, b in zip(*np.nonzero(linked), strict=True):
            take(int(rows[a]), int(other[b]))
    return found


def _sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in column]


def confirmed(kept: DataFrame, threshold: int) -> DataFrame:
    """Edges (source, target) of a spanning forest of the exact links in each pair of blocks."""
    schema = pa.schema([("source", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_groups(batches, KEYS):
            table = table.combine_chunks()
            rep, comp, block, p, q = (table[c].to_numpy() for c in ("rep", "comp", "block", "p", "q"))
            spans, found = _spans(table, KEYS), []
            for lo, hi in zip(spans[:-1], spans[1:], strict=True):
                sets = _sets_of(table["shingles"].slice(lo, hi - lo))
                found += _links(rep[lo:hi].tolist(), comp[lo:hi].tolist(), sets, block[lo:hi], p[lo] == q[lo], threshold, _Forest())
            if found:
                yield common.batch_of(schema, list(map(list, zip(*found, strict=True))))

    return kept.mapInArrow(run, "source long, target long")


LINK, MERGED = 0, 1


def linked_blocks(heads: DataFrame, cut: float, threshold: int) -> DataFrame:
    """Rows (kind, a, b) from blocks of classes: exact links between groups, and each group's new name."""
    keys = ["band", "key", "block"]
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_groups(batches, keys):
            table = table.combine_chunks()
            spans, rows = _spans(table, keys), []
            for lo, hi in zip(spans[:-1], spans[1:], strict=True):
                part = table.slice(lo, hi - lo)
                rep, comp, n = (part[c].to_numpy() for c in ("rep", "comp", "n_shingles"))
                bits = np.frombuffer(b"".join(part["bits"].to_pylist()), dtype="<u8").reshape(-1, 8)
                near = np.zeros(hi - lo, dtype=bool)
                i, j = np.triu_indices(hi - lo, 1)
                for at in range(0, len(i), PAIRS_AT_ONCE):
                    a, b = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
                    good = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]))
                    a, b = a[good], b[good]
                    good = estimate(bits[a], bits[b]) >= cut
                    near[a[good]] = True
                    near[b[good]] = True
                at = np.flatnonzero(near)
                if len(at):
                    forest = _Forest()
                    rows += [(LINK, a, b) for a, b in _links(rep[at].tolist(), comp[at].tolist(), _sets_of(part["shingles"].take(pa.array(at))), at, True, threshold, forest)]
                    rows += [(MERGED, c, forest.root(c)) for c in set(comp[at].tolist()) if forest.root(c) != c]
            if rows:
                yield common.batch_of(schema, list(map(list, zip(*rows, strict=True))))

    return heads.mapInArrow(run, "kind tinyint, a long, b long")


def contracted(placed: DataFrame, classes: DataFrame, texts_of: Callable[[DataFrame, int], DataFrame], words: int, cut: float, threshold: int, partitions: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rep, comp) of the classes of crowded buckets, and the links that made the groups.

    Their texts are set aside by one pass over the documents, whatever the number of rounds.

    At first every class counts in one bucket, so a group lies in one bucket too and its rows,
    dealt by the group's name, meet in one block: names need no components to be worked out.
    Then groups of ``MEMBERS`` classes or more, which are few, meet in all crowded buckets.
    """
    hot = placed.where(F.col("blocks") > 1)
    top = F.max(F.struct("count", (-F.col("band")).alias("back"), "key")).alias("top")
    own = hot.groupBy("rep").agg(top).select("rep", (-F.col("top.back")).alias("band"), F.col("top.key").alias("key"), F.col("rep").alias("comp"))
    own, before = write_counted(own, "crowded")
    texts = write_table(texts_of(own.select("rep"), before), "crowded_texts")
    links: list[DataFrame] = []

    def round_of(members: DataFrame, turn: int) -> tuple[DataFrame | None, int]:
        """Heads of the groups of each bucket, linked in blocks; None where there is nothing to link."""
        few = Window.partitionBy("band", "key", "comp").orderBy(F.xxhash64("rep", F.lit(turn)), "rep")
        heads = members if turn == 0 else members.withColumn("n", F.row_number().over(few)).where(F.col("n") <= HEADS).drop("n")
        rows_of = heads.groupBy("band", "key").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        dealt = heads.join(rows_of, ["band", "key"]).select("band", "key", "rep", "comp", F.pmod(F.xxhash64("comp", F.lit(turn)), F.ceil(F.col("rows") / BLOCK)).cast("int").alias("block"))
        dealt, n = write_counted(dealt, "heads")
        if not n or turn and n > 0.9 * before:
            return None, n
        full = dealt.join(classes.select("rep", "n_shingles", "bits"), "rep").join(shingle_sets(among(texts, dealt.select("rep"), n), words), "rep")
        told = write_table(linked_blocks(grouped(full, ["band", "key", "block"], partitions), cut, threshold), "contracted")
        links.append(told.where(F.col("kind") == LINK).select(F.col("a").alias("source"), F.col("b").alias("target")))
        return told.where(F.col("kind") == MERGED).select(F.col("a").alias("comp"), F.col("b").alias("name")), n

    for turn in range(CONTRACTIONS):
        names, before = round_of(own, turn)
        if names is None:
            break
        own = write_table(own.join(names, "comp", "left").select("rep", "band", "key", F.coalesce("name", "comp").alias("comp")), "crowded")
    groups, before = own.select("rep", "comp"), 1 << 62
    for turn in range(1, CONTRACTIONS):
        large = groups.groupBy("comp").count().where(F.col("count") >= MEMBERS).select("comp")
        names, before = round_of(hot.select("band", "key", "rep").join(groups.join(large, "comp"), "rep"), turn)
        if names is None or names.isEmpty():
            break
        merged = connected_components(names, "comp", "name").select(F.col("node").alias("comp"), F.col("component").alias("name"))
        groups = write_table(groups.join(merged, "comp", "left").select("rep", F.coalesce("name", "comp").alias("comp")), "crowded")
    drop_table(texts)
    return groups, links


def left_to_compare(placed: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(band, key, p, q, block, rep, comp): the pairs of blocks of each bucket in which groups still differ."""
    if groups is None:
        return placed.select("band", "key", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("block"), "rep", F.col("rep").alias("comp"))
    named = write_table(placed.join(groups, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "named")
    shares = named.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
    largest = shares.groupBy("band", "key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("groups")).where("groups > 1")
    # a small bucket has no largest group of its own: all its classes meet in one block
    small = F.col("all") <= BLOCK
    outside = F.when(small, F.col("all")).otherwise(F.col("all") - F.col("top.n"))
    cut = largest.select("band", "key", F.when(~small, F.col("top.comp")).alias("main"), F.ceil(outside / BLOCK).cast("int").alias("a"), F.when(small, 0).otherwise(F.ceil(F.col("top.n") / BLOCK)).cast("int").alias("g"))
    inside = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    spread = F.xxhash64("rep")
    dealt = named.join(cut, ["band", "key"]).withColumn("inside", inside).withColumn("block", F.when(F.col("inside"), F.col("a") + F.pmod(spread, F.greatest("g", F.lit(1)))).otherwise(F.pmod(spread, "a")).cast("int"))
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("a") - 1)).otherwise(F.sequence(F.lit(0), F.col("a") + F.col("g") - 1))
    twice = dealt.withColumn("other", F.explode(others))
    return twice.select("band", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "comp")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and its whole set of shingle hashes as little-endian uint64."""
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = common.per_process("shingler", str(words), lambda: Shingler(words))
        for batch in common.narrow_batches(batches, 500):
            yield common.batch_of(schema, [batch["doc_id"], [shingles_of(t.as_py()).tobytes() for t in batch["text"]]])

    return common.id_and_text(docs).mapInArrow(run, "rep long, shingles binary")


def among(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """doc_id and text of the documents that ``wanted`` (rep; ``n`` rows) names; others are not shuffled."""
    ids = wanted.select(F.col("rep").alias("doc_id"))
    possible = common.with_possible(docs.select("doc_id", "text"), ids, n).where("possible")
    return possible.join(ids.distinct(), "doc_id", "left_semi").select("doc_id", "text")


def grouped(df: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Two documents are linked if 100 * |A & B| >= threshold * |A | B| (``threshold`` of 80 or
    more).  A null, empty or blank text has an empty set, links with nothing and is kept; so
    is a row without a doc_id, whose component is null.  Rows that share a doc_id are one
    document for links, each with its own n_shingles.  Equal sets are one class.  A text of any
    length is shingled whole.  Links at the threshold itself count, and a group's name is its
    smallest doc_id, so there are no ties.  An empty table gives an empty result; extra
    columns are not read.
    """
    if threshold < 80:
        raise ValueError("bands are laid out for thresholds of 80 and more")
    cut = threshold / 100 - MARGIN
    partitions = partitions_for(docs)
    each = write_table(shingled(docs, words), "shingled")
    filled = each.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = write_table(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    classes = filled.join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("rep"), "n_shingles", "bits", "bands")
    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = banded.groupBy("band", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    placed, seen = write_observed(banded.join(crowded, ["band", "key"]), "placed", blocks=F.max("blocks"))

    groups, made = contracted(placed, classes, lambda wanted, n: among(docs, wanted, n), words, cut, threshold, partitions) if (seen["blocks"] or 0) > 1 else (None, [])
    buckets = left_to_compare(placed, groups).join(classes, "rep")
    kept, n = write_counted(likely(grouped(buckets, KEYS, partitions), cut, threshold), "likely")
    links = confirmed(grouped(kept.join(shingle_sets(among(docs, kept, n), words), "rep"), KEYS, partitions), threshold)
    for more in made:
        links = links.unionByName(more)
    repeated = filled.groupBy("doc_id").count().where("count > 1").select("doc_id")
    same_id = filled.join(repeated, "doc_id", "left_semi").join(reps, ["d1", "d2"]).select(F.col("doc_id").alias("source"), F.col("rep").alias("target"))
    groups = connected_components(write_table(links.unionByName(same_id).distinct(), "links"))
    ids = reps.join(groups, reps["rep"] == groups["node"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("found"))
    joined = each.join(ids, ["d1", "d2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents of which one per group stays, with their own columns.

    Of a group the row of the smallest doc_id stays, and rows that repeat this id stay with it;
    null, empty and blank texts and rows without a doc_id stay; an empty table stays empty.
    Rows are shuffled only where their id may be one of those that go.
    """
    drop, n = write_counted(near_duplicates(docs, **options).where("NOT kept").select("doc_id").distinct(), "dropped")
    column = "may_go"
    while column in docs.columns:
        column += "_"
    told = common.with_possible(docs, drop, n, column)
    stay = told.where(~F.col(column)).select(*docs.columns)
    return stay.unionByName(told.where(column).join(drop, "doc_id", "left_anti").select(*docs.columns))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
