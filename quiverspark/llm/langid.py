"""Language identification by a linear-chain conditional random field over words.

Labels are the languages of the training rows.  A word's potential is the sum of learned
weights of its features: the word itself (lexicon), its first and last one to three
letters (affixes) and its letter pairs and triples (n-grams).  Transitions between
neighbouring words are learned too, on sequences in which pieces of different languages
follow each other, so the field labels code-switched text.  Words are labelled by
forward-backward over the whole text; the document's language is the one with the most
expected words, its share the score.

Texts are cut into segments that run side by side: the product of a segment's matrices
carries messages over its borders exactly, so a very long text takes no more steps in
sequence than a short one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverspark.llm import common
from quiverspark.llm.toxicity import letters
from quiverspark.plans.workspace import write_table

SEGMENT = 128
MEMO_WORDS = 200_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Options:
    """Bounds of the training sample and of the training."""

    documents: int = 400  # of each language, in an order hashed from doc_id
    languages: int = 200  # those with the most sampled documents; ties by name
    drawn: int = 8  # pieces of each sampled document that training may use
    longest_word: int = 100  # characters; longer ones are left out of training pieces, not of labelling
    sequences: int = 1500
    pieces: int = 5
    piece_words: int = 24
    least: int = 3  # occurrences in the sample below which a feature is left out
    epochs: int = 3
    batch: int = 50
    rate: float = 0.05
    seed: int = 5


def features(word: str) -> list[str]:
    """Feature names of a lower-cased word; none for a word without letters."""
    w = letters(word)
    if not w:
        return []
    padded = f"^{w}$"
    found = [f"={w}", f"<{w[0]}", f">{w[-1]}"]
    if len(w) > 1:
        found += [f"<{w[:2]}", f">{w[-2:]}"]
    if len(w) > 2:
        found += [f"<{w[:3]}", f">{w[-3:]}"]
    found += [padded[k : k + 2] for k in range(1, len(padded) - 2)]
    found += [padded[k : k + 3] for k in range(len(padded) - 2)]
    return found


@dataclass
class Model:
    languages: list[str]
    rows: dict[str, int]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # (languages, languages), logs


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Probabilities of labels of all words of several texts, exactly, by forward-backward.

    ``emissions`` are log potentials of the words of all texts after one another.
    """
    labels = emissions.shape[1]
    out = np.zeros_like(emissions)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return out
    move = np.exp(transitions - transitions.max())
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    counts = -(-lengths // segment)
    text = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.repeat(np.cumsum(lengths) - lengths, counts) + place * segment
    size = np.minimum(segment, np.repeat(lengths, counts) - place * segment)
    order = np.argsort(-size, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # segments that reach beyond word t
    incoming = np.full((len(order), labels), 1 / labels)
    outgoing = np.full((len(order), labels), 1 / labels)
    if counts.max() > 1:
        product = np.repeat(np.eye(labels)[None], len(order), axis=0)
        for t, k in enumerate(active):
            step = (product[:k] @ move) * e[first[:k] + t][:, None, :]
            product[:k] = step / step.sum(axis=(1, 2), keepdims=True)
        head = np.cumsum(counts) - counts
        for s in range(1, counts.max()):
            texts = np.flatnonzero(counts > s)
            a = rank[head[texts] + s - 1]
            v = np.einsum("nl,nlm->nm", incoming[a], product[a])
            incoming[rank[head[texts] + s]] = v / v.sum(axis=1, keepdims=True)
        for s in range(counts.max() - 1, 0, -1):
            texts = np.flatnonzero(counts > s)
            b = rank[head[texts] + s]
            v = np.einsum("nlm,nm->nl", product[b], outgoing[b])
            outgoing[rank[head[texts] + s - 1]] = v / v.sum(axis=1, keepdims=True)
    alpha = incoming.copy()
    for t, k in enumerate(active):
        at = first[:k] + t
        step = (alpha[:k] @ move) * e[at]
        alpha[:k] = step / step.sum(axis=1, keepdims=True)
        out[at] = alpha[:k]
    beta = outgoing.copy()
    back = move.T
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        both = out[at] * beta[:k]
        out[at] = both / both.sum(axis=1, keepdims=True)
        step = (e[at] * beta[:k]) @ back
        beta[:k] = step / step.sum(axis=1, keepdims=True)
    return out


class Labeller:
    """Labels texts with a model; remembers words of this process."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, int] = {}
        self.vectors = np.zeros((1 << 12, len(self.model.languages)))
        self.lettered = np.zeros(1 << 12, dtype=bool)

    def _learn(self, new: list[str]) -> None:
        at, rows, weights = len(self.memo), self.model.rows, self.model.weights
        while at + len(new) > len(self.vectors):
            self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
            self.lettered = np.concatenate((self.lettered, np.zeros_like(self.lettered)))
        names = [features(w) for w in new]
        known = [[rows[f] for f in fs if f in rows] for fs in names]
        sizes = np.array([len(k) for k in known])
        flat = np.array([r for k in known for r in k], dtype=np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            self.vectors[at + some] = np.add.reduceat(weights[flat], starts, axis=0)
        self.lettered[at : at + len(new)] = [bool(fs) for fs in names]
        self.memo.update(zip(new, range(at, at + len(new)), strict=True))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, whether words have letters, and words per text."""
        words = [t.lower().split() for t in texts]
        new = set().union(*words).difference(self.memo)
        if new:
            self._learn(sorted(new))
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        index = np.fromiter((i for w in words for i in map(self.memo.__getitem__, w)), dtype=np.int64, count=int(lengths.sum()))
        vectors, lettered = self.vectors[index], self.lettered[index]
        if len(self.memo) > MEMO_WORDS:  # keep the words that came first: among them are the frequent ones
            for w in new:
                del self.memo[w]
        return marginals(vectors, lengths, self.model.transitions), lettered, lengths

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        probabilities, lettered, lengths = self.words(texts)
        weighed = probabilities * lettered[:, None]
        sums = np.zeros((len(texts), len(self.model.languages)))
        some = np.flatnonzero(lengths)
        if len(some):
            sums[some] = np.add.reduceat(weighed, (np.cumsum(lengths) - lengths)[some], axis=0)
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        score = np.where(total > 0, sums[np.arange(len(texts)), best] / np.maximum(total, 1e-300), 0.0)
        return [self.model.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)], np.clip(score, 0, 1)


def draw(text: str, seed: int, options: Options) -> list[list[str]]:
    """Pieces of a text for training, at random places of the whole of it."""
    words = [w for w in text.lower().split() if len(w) <= options.longest_word and letters(w)]
    rng = np.random.default_rng(seed)
    pieces = []
    for _ in range(options.drawn if words else 0):
        size = 1 + int(rng.integers(2 * options.piece_words))
        at = int(rng.integers(max(1, len(words) - size + 1)))
        pieces.append(words[at : at + size])
    return pieces


def train(texts: list[str], langs: list[str], options: Options = Options()) -> Model:
    """Fit on pieces drawn from given texts."""
    return train_on([draw(t, i, options) for i, t in enumerate(texts)], langs, options)


def train_on(drawn: list[list[list[str]]], langs: list[str], options: Options = Options()) -> Model:
    """Fit weights and transitions on code-switched sequences of the documents' pieces."""
    rng = np.random.default_rng(options.seed)
    languages = sorted(set(langs))
    usable = [[i for i in range(len(drawn)) if langs[i] == name and drawn[i]] for name in languages]
    languages, usable = [n for n, u in zip(languages, usable, strict=True) if u], [u for u in usable if u]
    if not languages:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)))
    n = len(languages)
    memo: dict[str, int] = {}
    sequences, labels = [], []
    for _ in range(options.sequences):
        ids, tags = [], []
        for _ in range(options.pieces):
            k = int(rng.integers(n))
            source = drawn[usable[k][int(rng.integers(len(usable[k])))]]
            piece = source[int(rng.integers(len(source)))]
            ids += [memo.setdefault(w, len(memo)) for w in piece]
            tags += [k] * len(piece)
        sequences.append(np.array(ids))
        labels.append(np.array(tags))
    names = [features(w) for w in memo]
    seen: dict[str, int] = {}
    uses = np.bincount(np.concatenate(sequences), minlength=len(memo))
    for fs, u in zip(names, uses, strict=True):
        for f in fs:
            seen[f] = seen.get(f, 0) + int(u)
    rows = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= options.least))}
    lists = [np.array([rows[f] for f in fs if f in rows], dtype=np.int64) for fs in names]
    counts = np.full((len(rows), n), 0.5)
    for ids, tags in zip(sequences, labels, strict=True):
        for i, k in zip(ids, tags, strict=True):
            counts[lists[i], k] += 1
    share = np.log(counts / counts.sum(axis=0))
    weights = 0.15 * (share - share.mean(axis=1, keepdims=True))
    transitions = np.where(np.eye(n, dtype=bool), 1.5, -1.5)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    step = 0
    for _ in range(options.epochs):
        for part in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // options.batch)):
            step += 1
            flat, tags = np.concatenate([sequences[i] for i in part]), np.concatenate([labels[i] for i in part])
            lengths = np.array([len(sequences[i]) for i in part])
            used, at = np.unique(flat, return_inverse=True)
            sizes = np.array([len(lists[u]) for u in used])
            cells = np.concatenate([lists[u] for u in used])
            vectors = np.zeros((len(used), n))
            some = np.flatnonzero(sizes)
            vectors[some] = np.add.reduceat(weights[cells], (np.cumsum(sizes) - sizes)[some], axis=0)
            emissions = vectors[at]
            p = marginals(emissions, lengths, transitions, segment=10_000)
            error = p.copy()
            error[np.arange(len(flat)), tags] -= 1
            by_word = np.zeros((len(used), n))
            np.add.at(by_word, at, error)
            spread = np.repeat(by_word, sizes, axis=0)
            g_w = np.stack([np.bincount(cells, weights=spread[:, k], minlength=len(rows)) for k in range(n)], axis=1) / len(flat)
            # expected moves, from neighbouring beliefs and the potentials between them
            inside = np.ones(len(flat), dtype=bool)
            inside[np.cumsum(lengths) - 1] = False
            i = np.flatnonzero(inside)
            joint = pair_marginals(emissions, lengths, transitions)[i]
            g_t = joint.sum(axis=0)
            np.add.at(g_t, (tags[i], tags[i + 1]), -1)
            for value, g, m, v in ((weights, g_w + 1e-6 * weights, moments[0], moments[1]), (transitions, g_t / len(flat), moments[2], moments[3])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                value -= options.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
    return Model(languages, rows, weights, transitions)


def pair_marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probabilities of label pairs of each word and the next (of no meaning at a text's last word); for training."""
    n = emissions.shape[1]
    move, e = np.exp(transitions - transitions.max()), np.exp(emissions - emissions.max(axis=1, keepdims=True))
    ends, starts = np.cumsum(lengths), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, size = starts[order], lengths[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    state = np.full((len(order), n), 1 / n)
    for t, k in enumerate(active):
        v = (state[:k] @ move) * e[first[:k] + t]
        state[:k] = v / v.sum(axis=1, keepdims=True)
        alpha[first[:k] + t] = state[:k]
    state = np.full((len(order), n), 1 / n)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        beta[first[:k] + t] = state[:k]
        v = (e[first[:k] + t] * state[:k]) @ move.T
        state[:k] = v / v.sum(axis=1, keepdims=True)
    following = np.minimum(np.arange(len(e)) + 1, ends[-1] - 1)
    joint = alpha[:, :, None] * move[None] * (e * beta)[following][:, None, :]
    return joint / joint.sum(axis=(1, 2), keepdims=True)


def fit(docs: DataFrame, options: Options = Options()) -> Model:
    """Train on rows outside the held-out fold (crc32 of the id modulo 3 is 1) that have a language.

    ``documents`` rows of each language at most, in an order hashed from doc_id, are chosen in
    one pass over the narrow columns, so other rows' texts are not moved; a second pass draws
    pieces of their whole texts where they lie.  The driver sees ``drawn`` pieces a document.
    A doc_id that has several languages counts for each; of its repeated rows one counts.
    """
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where((common.fold_of("doc_id", 3) != 1) & F.col("lang").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")  # cut in the tasks before the shuffle
    sampled = write_table(known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= options.documents).select("doc_id", "lang").distinct(), "sampled")
    frequent = sampled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(options.languages).select("lang")
    ids = sampled.join(frequent, "lang", "left_semi").select("doc_id", F.col("lang").alias("wanted")).collect()
    few = spark.createDataFrame([tuple(r) for r in ids], "doc_id long, wanted string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    rows = texts.join(F.broadcast(few), "doc_id").where("lang = wanted").select("doc_id", "lang", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("pieces", pa.list_(pa.list_(pa.string())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.narrow_batches(batches):
            drawn = [draw(t, i & 0x7FFFFFFF, options) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            yield common.batch_of(schema, [batch["doc_id"], batch["lang"], drawn])

    found = rows.mapInArrow(run, "doc_id long, lang string, pieces array<array<string>>").collect()
    one = {(r["doc_id"], r["lang"]): r["pieces"] for r in sorted(found)}
    keys = sorted(one)
    return train_on([one[k] for k in keys], [lang for _, lang in keys], options)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A null, empty or letterless text is ``und`` with score 0; a text of any length is labelled
    whole, in segments that run side by side; a null doc_id stays null and
    counts as not held out; equal languages at the top go to the first by name; repeated rows
    are labelled alike; extra columns are not read; an empty table gives no rows.
    """
    shared, version = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = common.per_process("langid", version, lambda: Labeller(shared.value))
        for batch in common.narrow_batches(batches, 400):
            yield common.batch_of(schema, [batch["doc_id"], *labeller.texts(batch["text"].to_pylist())])

    told = common.id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return told.select("doc_id", F.coalesce(common.fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
