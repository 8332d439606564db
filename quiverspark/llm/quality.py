"""Quality rules: an isolation forest over rule statistics.

A narrow map counts, over each whole text, what quality rules look at: words, symbols,
repeated lines and windows, capitals, bars, exclamation marks, distinct words.  Each
statistic counts from the point where its rule begins to bite, so lawful variety is flat: on
raw statistics the forest isolates lawful texts first (the README has the figures).  Two plain
rules reject first.
The verdict on the rest is an isolation forest's: random splits isolate unusual rows
in few steps, so the mean path length over the trees, set against what a random binary
tree would need, is an anomaly score.  The forest grows on a bounded sample of documents;
the score above which a document goes is calibrated on all labelled rows, by aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark.llm import common
from quiverspark.plans.workspace import write_table

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What each share may be before it counts, and the excess at which it counts in full.
RULES = {"symbols_a_word": (0.1, 0.5), "bars_a_word": (0.05, 0.4), "shouts_a_word": (0.1, 0.9), "capitals": (0.3, 0.7), "stale_words": (0.0, 1.0)}
SHARES = list(RULES)

_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"])
_SPACES = np.array([0x20, 9, 10, 11, 12, 13])
_CAPITALS = np.arange(65, 91)
_SMALL = np.arange(97, 123)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    x = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        x ^= x >> np.uint64(31)
    ordered = np.sort(x)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(np.isin(x, twice))
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split("\n") if x and (x[0] > " " or x.strip(" \t\r\x0b\x0c"))]
    return len(lines) - len(set(lines)), len(lines)


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the shares of ``SHARES`` of one text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(SHARES)
    bytes_of = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    word_chars = len(text) - int(bytes_of[_SPACES].sum())
    symbols = int(bytes_of[_SYMBOLS].sum())
    dup_lines, _ = repeated_lines(text)
    repeats = repeated_words(words)
    capitals, small = int(bytes_of[_CAPITALS].sum()), int(bytes_of[_SMALL].sum())
    found = {
        "symbols_a_word": symbols / n,
        "bars_a_word": int(bytes_of[ord("|")]) / n,
        "shouts_a_word": int(bytes_of[ord("!")]) / n,
        "capitals": capitals / max(1, capitals + small),
        # how far distinct words fall short of what a text of this length may be expected to have
        "stale_words": 1 - len(set(words)) / n**0.9,
    }
    shares = [min(1.0, max(0.0, found[k] - free) / full) for k, (free, full) in RULES.items()]
    return [n, word_chars, symbols, dup_lines, repeats], shares


@dataclass(frozen=True)
class Options:
    """Bounds of the samples, and the forest's shape."""

    sample: int = 4096  # documents for the forest
    trees: int = 128
    rows_a_tree: int = 128
    keep: float = 0.998  # of the labelled good rows that must stay
    seed: int = 11


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    many = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays."""

    def __init__(self, rows: np.ndarray, options: Options):
        rng = np.random.default_rng(options.seed)
        self.size = min(options.rows_a_tree, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(options.trees)] if self.size > 1 else []

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = math.ceil(math.log2(len(rows)))
        feature, split, left, length = [], [], [], []
        todo = [(rows, 0)]
        at = 0
        # breadth first, so that a node's right child follows its left one
        while at < len(todo):
            part, depth = todo[at]
            at += 1
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= limit or len(part) < 2 or not len(open_):
                feature.append(-1)
                split.append(0.0)
                left.append(0)
                length.append(depth + float(expected_path(len(part))))
                continue
            k = int(rng.choice(open_))
            value = rng.uniform(low[k], high[k])
            below = part[:, k] < value
            feature.append(k)
            split.append(value)
            left.append(len(todo))
            length.append(0.0)
            todo += [(part[below], depth + 1), (part[~below], depth + 1)]
        return np.array(feature), np.array(split), np.array(left), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, between 0 and 1."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, split, left, length in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            going = np.arange(len(rows))
            while len(going):
                k = feature[node[going]]
                going, k = going[k >= 0], k[k >= 0]
                here = node[going]
                node[going] = left[here] + (rows[going, k] >= split[here])
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, float(expected_path(self.size))))


@dataclass
class Model:
    forest: Forest
    threshold: float


BINS = 1024


def _ranked(scores: DataFrame, rank: int) -> float:
    """The value of the column ``anomaly`` that ``rank`` values precede in order: bins around it are counted
    and narrowed until one value is left, so at most ``BINS`` rows at a time reach the driver."""
    low, high = scores.agg(F.min("anomaly"), F.max("anomaly")).first()
    while low < high:
        place = F.least(F.floor((F.col("anomaly") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = scores.where(F.col("anomaly").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("anomaly"), F.max("anomaly"))
        for _, n, low, high in sorted(bins.collect()):
            if rank < n:
                break
            rank -= n
    return float(low)


def calibrated(scored: DataFrame, keep: float) -> float:
    """The lowest threshold that keeps the asked share of good rows, raised while that rejects no fewer bad ones.

    ``scored`` has ``anomaly`` and ``good`` of every labelled row.
    """
    n_good, n = scored.agg(F.count_if("good"), F.count("*")).first()
    if n_good in (0, n):
        return 1.0
    limit = _ranked(scored.where("good"), min(n_good - 1, math.ceil(keep * n_good)))
    above = scored.where(~F.col("good") & (F.col("anomaly") > limit)).agg(F.min("anomaly")).first()[0]
    return float((limit + above) / 2) if above is not None else 1.0


SHARES_TYPE = pa.list_(pa.float64())
MEASURED = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("shares", SHARES_TYPE)])
MEASURED_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", shares array<double>"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the shares of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_nothing()
        for batch in common.narrow_batches(batches):
            both = [statistics(t) for t in batch["text"].to_pylist()]
            yield common.batch_of(MEASURED, [batch["doc_id"], *map(list, zip(*[c for c, _ in both], strict=True)), [s for _, s in both]])

    return common.id_and_text(docs).mapInArrow(run, MEASURED_DDL)


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """Measured rows with their anomaly in place of the shares."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_nothing()
        for batch in batches:
            shares = batch["shares"].flatten().to_numpy().reshape(-1, len(SHARES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(shares))], names=[*batch.schema.names[:-1], "anomaly"])

    return rows.mapInArrow(run, MEASURED_DDL.replace("shares array<double>", "anomaly double"))


def fit(rows: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    """Grow the forest on a bounded sample of measured rows and calibrate it on all labelled ones.

    The sample is taken in an order hashed from doc_id; only its ids and shares pass the driver.
    Rows of one doc_id count once, by their largest anomaly.
    """
    spark = rows.sparkSession
    ids = rows.select("doc_id").where("doc_id IS NOT NULL")
    sampled = [(r[0],) for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.sample).collect()]
    long = rows.where(f"n_words >= {LEAST_WORDS}")
    few = long.join(F.broadcast(spark.createDataFrame(sampled, "doc_id long")), "doc_id", "left_semi").select("doc_id", "shares").dropDuplicates(["doc_id"]).collect()
    few.sort(key=lambda r: r["doc_id"])
    forest = Forest(np.array([r["shares"] for r in few]).reshape(-1, len(SHARES)), options)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality IN (0, 1)")
    told = scored(long.join(known, "doc_id", "left_semi"), forest).groupBy("doc_id").agg(F.max("anomaly").alias("anomaly"))
    told = write_table(told.join(known, "doc_id").select("anomaly", (F.col("quality") == 1).alias("good")), "calibration")
    return Model(forest, calibrated(told, options.keep))


def judge(rows: DataFrame, model: Model) -> DataFrame:
    """Add base_failed, anomaly and kept to measured rows."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored(rows, model.forest).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= model.threshold))


def verdicts(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and anomaly of every row.

    A null, empty or blank text has no words and fails; a text of any length is counted whole;
    an anomaly at the threshold itself is kept; a null doc_id stays null; repeated rows are
    judged alike; extra columns are not read; an empty table gives no rows.  Without
    labels of both kinds only the plain rules reject.
    """
    rows = write_table(measured(docs), "measured")
    return judge(rows, fit(rows, labels, options)).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def rule_abiding(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """The documents that are kept, with their own columns; one narrow pass over the texts to measure and one to keep.

    Rows are judged as by ``verdicts``: null, empty and blank texts go, rows without a doc_id and
    repeated rows stay or go by their texts, an empty table stays empty.
    """
    model = fit(write_table(measured(docs), "measured"), labels, options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_nothing()
        for batch in common.narrow_batches(batches):
            both = [statistics(t or "") for t in batch["text"].to_pylist()]
            counts = np.array([c for c, _ in both]).reshape(-1, len(COUNTS))
            fine = (counts[:, 0] >= LEAST_WORDS) & (100 * counts[:, 4] <= MOST_REPEATED * counts[:, 0])
            fine &= shared.value.forest.score(np.array([s for _, s in both]).reshape(-1, len(SHARES))) <= shared.value.threshold
            yield batch.filter(pa.array(fine))

    return common.text_batches(docs).mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule statistics and verdict."""
    return verdicts(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
