"""Personal data: plain patterns, and a skip-chain conditional random field that adds to them.

Base spans come from four patterns and their checks and always stay.  All other tokens with a
digit or an at sign are nodes of the field beside them, with labels none, email, ip, card,
phone: *doubtful* ones, whose shape a pattern swallowed, broke or missed, and plain ones.
Neighbours in the text are joined in a chain, tokens with equal or similar content by skip
edges, however far apart; sum-product messages run until they settle, and a token whose
belief in a kind passes one half becomes a span of it.

What a token says for a kind is a weak prior by its shape plus learned weights of features:
its shape, its digits, the checks that it fails, the words beside it.  They and the strengths
of the edges are fitted by pseudo-likelihood on a bounded sample, in which base spans are
labels of their kinds and plain tokens, and those that fail a check, are labels of none;
doubtful ones have no label.  What a base pattern is sure to show (a plus sign, a valid check
digit) is hidden from half of the labelled spans, so that their other features learn to stand
alone.  Learned evidence is bounded, so a token that looks like nothing needs a found one of
its content to become a span.

Equal tokens are joined each to the next, so edges grow with the tokens and not with
their pairs.  What a base span says about its content reaches every repeat all the same: a
clamped neighbour's message is a constant, so it is added to the repeat's evidence without
an edge.  Doubtful tokens of one content share the evidence of the best supported of them,
as repeats of one string are no independent witnesses.
The map is narrow; texts without a digit and an at sign cost one search.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverspark.llm import common

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^ \t\r\n\x0b\x0c]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")

#: Doubtful tokens: shapes that the patterns above swallow, break or miss.
_SHAPES = {
    "card": re.compile(r"(?<![0-9.+-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9]|[.-][0-9])"),
    "ip": re.compile(r"(?<![0-9.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    "phone": re.compile(r"(?<![0-9.])\+?[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
_AT = re.compile(r" ?@ ?| ?[\[(]at[\])] ?")
_NEAR_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)*")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, found from each at sign."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def in_octet(part: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the ip pattern whose parts fit: each run of digits and single dots
    is met once, and every four parts of it are one match."""
    found = []
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(in_octet, four)):
                found.append((at, end))
            at = end + 1
    return found


def near_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with spaces about the sign, or with a sign or dots spelt in brackets: from each sign outwards,
    so a long run of letters is walked through once."""
    found, free = [], 0
    for sign in _AT.finditer(text):
        start = sign.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _NEAR_DOMAIN.match(text, sign.end()) if start < sign.start() else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, sign.start())
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; matches that fail their check are dropped."""
    spans = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", a, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGITS.sub("", m.group())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return spans


def doubtful(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, evidence for none and the four kinds) of tokens that no base span touches."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b)) - 1
        return k < 0 or reach[k] <= a

    found: dict[tuple[int, int], np.ndarray] = {}

    def add(a: int, b: int, kind: str, weight: float) -> None:
        if free(a, b):
            found.setdefault((a, b), np.zeros(5))[1 + KINDS.index(kind)] += weight - 2.0

    if _DIGIT.search(text):
        for kind, shape in _SHAPES.items():
            for m in shape.finditer(text):
                digits = _NOT_DIGITS.sub("", m.group())
                if kind == "card":
                    good = 4.0 if 13 <= len(digits) <= 19 and luhn(digits) else 0.0
                elif kind == "ip":
                    good = 4.0 if all(int(p) <= 255 for p in m.group().split(".")) else 0.0
                else:
                    good = 4.0 if m.group()[0] == "+" and 9 <= len(digits) <= 15 else 1.0
                add(m.start(), m.end(), kind, good)
    if "@" in text or "at]" in text or "at)" in text:
        for a, b in near_emails(text):
            token = text[a:b]
            add(a, b, "email", 3.0 if "." in token.partition("@")[2] or "dot" in token else 0.5)
    locals_ = {text[a:b].partition("@")[0] for k, a, b in base if k == "email"}
    locals_ = {local for local in locals_ if len(local) >= 6 and _DIGIT.search(local)}
    for m in _LOCAL_RUN.finditer(text) if locals_ else ():
        run = m.group() if m.group() in locals_ else m.group().rstrip(".")  # a full stop may follow
        if run in locals_ and text[m.end() : m.end() + 1] != "@":
            add(m.start(), m.start() + len(run), "email", 0.0)
    # of doubtful tokens that overlap, the better supported one, then the longer one, stays
    chosen: list[tuple[int, int, np.ndarray]] = []
    covered = bytearray(len(text) if found else 0)
    for (a, b), evidence in sorted(found.items(), key=lambda x: (-x[1][1:].max(), x[0][0] - x[0][1], x[0])):
        if not any(covered[a:b]):
            chosen.append((a, b, evidence))
            covered[a:b] = b"\x01" * (b - a)
    return sorted(chosen, key=lambda x: x[:2])


CLAMP, SAME, ALIKE, NEAR = 12.0, 3.0, 1.0, 0.4
UNLIKE, PLAIN = -8.0, -6.0  # prior evidence for a kind that a shape rules out, and for a plain token
NEAR_CHARACTERS = 60
ROUNDS, SETTLED = 30, 1e-4
LEARNED = 4.0  # bound of the learned evidence for a kind


@dataclass(frozen=True)
class Options:
    """Bounds of the sample that the field is fitted on, and of the fitting."""

    documents: int = 3000  # with a digit or an at sign, in an order hashed from doc_id
    nodes: int = 400  # of a sampled document; one with more takes no part in fitting
    least: int = 5  # labelled nodes that must show a feature before it counts
    steps: int = 80
    rate: float = 0.1
    decay: float = 0.02
    seed: int = 13


@dataclass(frozen=True)
class Field:
    """Learned weights (5 labels) by hashed feature, and strengths of the edges."""

    weights: dict[int, np.ndarray] = field(default_factory=dict)
    same: float = SAME
    alike: float = ALIKE
    near: float = NEAR

    def evidence(self, features: list[int]) -> np.ndarray:
        """Bounded learned evidence for each label against none."""
        known = [self.weights[f] for f in features if f in self.weights]
        if not known:
            return np.zeros(5)
        total = np.sum(known, axis=0)
        return np.clip(total - total[0], -LEARNED, LEARNED)


#: The field before any fitting.
PRIOR = Field()
_RUNS = re.compile(r"[0-9]+|[A-Za-z]+")
_WORD = re.compile(r"[^\W\d_]+")


def _run(m: re.Match) -> str:
    n = m.end() - m.start()
    return ("9" if m.group()[0] <= "9" else "a") + (str(n) if n < 5 else "5-8" if n < 9 else "9+")


def features_of(text: str, a: int, b: int) -> tuple[list[int], list[int]]:
    """Hashed features of a token: those that base patterns do not decide by, and those that they do."""
    token = text[a:b]
    digits = _NOT_DIGITS.sub("", token[:80])
    before, after = _WORD.findall(text[max(0, a - 24) : a]), _WORD.findall(text[b : b + 24])
    plain = ["all", f"n{min(len(digits), 20)}", "s" + _RUNS.sub(_run, token[:60].lstrip("+")) if "@" not in token else "s@"]
    plain += [f"p{before[-1].lower()}"] if before else []
    plain += [f"f{after[0].lower()}"] if after else []
    if 13 <= len(digits) <= 19 and not luhn(digits):
        plain.append("no check digit")
    parts = token.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and not all(map(in_octet, parts)):
        plain.append("no octets")
    sure = ["plus"] if token[:1] == "+" else []
    sure += ["check digit"] if 13 <= len(digits) <= 19 and luhn(digits) else []
    sure += ["domain"] if "@" in token and "." in token.partition("@")[2] else []
    return [zlib.crc32(f.encode()) for f in plain], [zlib.crc32(f.encode()) for f in sure]


def plain_tokens(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Words with a digit or an at sign, without the marks about them, that no taken span touches."""
    found, at = [], 0
    taken = sorted(taken)
    for m in _TOKEN.finditer(text):
        if not _SIGN.search(m.group()):
            continue
        word = m.group().strip(".,;:!?()[]{}\"'")
        a = m.start() + m.group().find(word)
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if word and (at == len(taken) or taken[at][0] >= a + len(word)):
            found.append((a, a + len(word)))
    return found


def _contents(token: str) -> tuple[str, str]:
    """What makes two tokens equal, and what makes them alike."""
    digits = _NOT_DIGITS.sub("", token)
    if "@" in token:
        return token.lower().partition("@")[0], "@" + token.lower().partition("@")[2]
    if len(digits) >= 9:
        return digits[-10:], f"{len(digits)}:{digits[:4]}"
    return token.lower(), token.lower()


def skip_edges(tokens: list[str], field: Field = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of token numbers and their weights: each token with the next equal and the next similar one."""
    pairs, weights, last = [], [], {}
    for i, token in enumerate(tokens):
        for likeness, (key, weight) in enumerate(zip(_contents(token), (field.same, field.alike), strict=True)):
            j = last.get((likeness, key))
            if j is not None:
                pairs.append((j, i))
                weights.append(weight)
            last[(likeness, key)] = i
    return np.array(pairs, dtype=np.int64).reshape(-1, 2), np.array(weights)


def anchored(tokens: list[str], kinds: list[str | None], field: Field = PRIOR) -> np.ndarray:
    """Evidence (tokens, labels) from the base spans, those with a kind, for each other token of their
    content or likeness that no skip edge joins to such a span."""
    drawn, places = np.zeros((len(tokens), 5)), {}
    for i, token in enumerate(tokens):
        for likeness, key in enumerate(_contents(token)):
            places.setdefault((likeness, key), []).append(i)
    for (likeness, _), found in places.items():
        known = {kinds[i] for i in found} - {None}
        for n, i in enumerate(found if known else []):
            if kinds[i] is None:
                beside = {kinds[j] for j in found[max(0, n - 1) : n + 2]}
                for kind in known - beside:
                    drawn[i, 1 + KINDS.index(kind)] += (field.same, field.alike)[likeness]
    return drawn


def beliefs(evidence: np.ndarray, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loopy sum-product over Potts edges; evidence and result are (nodes, labels)."""
    if not len(pairs):
        e = np.exp(evidence - evidence.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    source = np.concatenate((pairs[:, 0], pairs[:, 1]))
    target = np.concatenate((pairs[:, 1], pairs[:, 0]))
    gain = np.expm1(np.concatenate((weights, weights)))[:, None]
    back = np.roll(np.arange(len(source)), len(pairs))
    log_m = np.zeros((len(source), evidence.shape[1]))
    for _ in range(ROUNDS):
        total = evidence.copy()
        np.add.at(total, target, log_m)
        h = total[source] - log_m[back]
        h = np.exp(h - h.max(axis=1, keepdims=True))
        h /= h.sum(axis=1, keepdims=True)
        new = np.log1p(gain * h)
        new -= new.mean(axis=1, keepdims=True)
        change = np.abs(new - log_m).max()
        log_m = 0.5 * log_m + 0.5 * new
        if change < SETTLED:
            break
    total = evidence.copy()
    np.add.at(total, target, log_m)
    e = np.exp(total - total.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field = PRIOR) -> list[tuple[str, int, int]]:
    """Spans that the field adds to the base ones."""
    if not _SIGN.search(text) and "at]" not in text and "at)" not in text:
        return []
    extra = doubtful(text, base)
    plain = plain_tokens(text, [(a, b) for _, a, b in base] + [(a, b) for a, b, _ in extra])
    if not extra and not base and not field.weights:
        return []  # the prior alone finds nothing in plain tokens
    others = [(a, b) for a, b, _ in extra] + plain
    if not others:
        return []
    nodes = [(a, b, k) for k, a, b in base] + [(a, b, None) for a, b in others]
    evidence = np.zeros((len(nodes), 5))
    for i, (kind, _, _) in enumerate(base):
        evidence[i, 1 + KINDS.index(kind)] = CLAMP
    evidence[len(base) + len(extra) :, 1:] = PLAIN
    shared: dict[str, np.ndarray] = {}
    contents = [_contents(text[a:b])[0] for a, b, _ in extra]
    for content, (_, _, e) in zip(contents, extra, strict=True):
        e = np.where(e == 0, UNLIKE, e)
        shared[content] = np.maximum(shared.get(content, e), e)
    for i, (content, (_, _, e)) in enumerate(zip(contents, extra, strict=True)):
        evidence[len(base) + i] = np.where(e == 0, UNLIKE, shared[content])
        evidence[len(base) + i, 0] = 0.0
    if field.weights:
        for i, (a, b) in enumerate(others):
            ordinary, sure = features_of(text, a, b)
            evidence[len(base) + i] += field.evidence(ordinary + sure)
    order, tokens, pairs, weights = _edges(text, nodes, field)
    evidence[order] += anchored(tokens, [nodes[i][2] for i in order], field)
    b = beliefs(evidence, pairs, weights)
    found = []
    for i, (a, end) in enumerate(others):
        k = int(b[len(base) + i].argmax())
        if k and b[len(base) + i, k] > 0.5:
            found.append((KINDS[k - 1], a, end))
    return found


def _edges(text: str, nodes: list[tuple], field: Field) -> tuple[list[int], list[str], np.ndarray, np.ndarray]:
    """Nodes in the order of the text, their tokens, and the edges: the chain first, then the skip edges."""
    order = sorted(range(len(nodes)), key=lambda i: nodes[i][:2])
    close = [(i, j) for i, j in zip(order, order[1:], strict=False) if nodes[j][0] - nodes[i][1] <= NEAR_CHARACTERS]
    tokens = [text[nodes[i][0] : nodes[i][1]] for i in order]
    ranked, weights = skip_edges(tokens, field)
    skips = np.array(order)[ranked] if len(ranked) else ranked
    pairs = np.concatenate((np.array(close, dtype=np.int64).reshape(-1, 2), skips))
    return order, tokens, pairs, np.concatenate((np.full(len(close), field.near), weights))


# --- fitting -----------------------------------------------------------------------------


def example(text: str, options: Options = Options()) -> tuple[list[list[int]], list[list[int]], list[int], list[tuple[int, int, int]]] | None:
    """A text's nodes for fitting: ordinary and sure features, labels (-1 for none given), edges with their sort."""
    base = base_spans(text)
    extra = doubtful(text, base)
    spans = [(a, b) for _, a, b in base] + [(a, b) for a, b, _ in extra]
    plain = plain_tokens(text, spans)
    if not 0 < len(spans) + len(plain) <= options.nodes:
        return None
    both = [features_of(text, a, b) for a, b in spans + plain]
    failed = {zlib.crc32(b"no check digit"), zlib.crc32(b"no octets")}
    labels = [1 + KINDS.index(k) for k, _, _ in base]
    labels += [0 if failed & set(f) else -1 for f, _ in both[len(base) : len(spans)]] + [0] * len(plain)
    _, _, pairs, weights = _edges(text, [(a, b, None) for a, b in spans + plain], Field(same=1, alike=2, near=0))
    return [f for f, _ in both], [f for _, f in both], labels, [(int(i), int(j), int(w)) for (i, j), w in zip(pairs, weights, strict=True)]


def learn(examples: list, options: Options = Options()) -> Field:
    """Weights and edge strengths by pseudo-likelihood: each labelled node given its labelled neighbours."""
    rng = np.random.default_rng(options.seed)
    nodes, labels, edges = [], [], []
    for ordinary, sure, found, links in examples:
        first = len(nodes)
        for f, s, y in zip(ordinary, sure, found, strict=True):
            nodes.append(f + (s if y < 1 or rng.random() < 0.5 else []))
            labels.append(y)
        edges += [(first + i, first + j, w) for i, j, w in links]
    y = np.array(labels, dtype=np.int64)
    if not len(y) or (y > 0).sum() == 0 or (y == 0).sum() == 0:
        return PRIOR
    seen = np.flatnonzero(y >= 0)
    shown: dict[int, int] = {}
    for i in seen:
        for f in set(nodes[i]):
            shown[f] = shown.get(f, 0) + 1
    column = {f: k for k, f in enumerate(sorted(f for f, n in shown.items() if n >= options.least))}
    cells = [[column[f] for f in nodes[i] if f in column] for i in seen]
    owner = np.repeat(np.arange(len(seen)), [len(c) for c in cells])
    flat = np.array([c for cs in cells for c in cs], dtype=np.int64)
    row = np.full(len(y), -1)
    row[seen] = np.arange(len(seen))
    # labels of a node's labelled neighbours, counted by the sort of edge
    beside = np.zeros((3, len(seen), 5))
    for i, j, w in edges:
        if y[i] >= 0 and y[j] >= 0:
            beside[w, row[i], y[j]] += 1
            beside[w, row[j], y[i]] += 1
    truth = np.eye(5)[y[seen]]
    # kinds are rare beside plain numbers: each label weighs the square root of its share
    weight = (1 / np.sqrt(np.maximum(1, truth.sum(axis=0))))[y[seen]]
    weight = (weight / weight.sum())[:, None]
    prior = np.array([NEAR, SAME, ALIKE])
    w, edge = np.zeros((len(column), 5)), prior.copy()
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros(3), np.zeros(3)]
    for step in range(1, options.steps + 1):
        logits = np.stack([np.bincount(owner, weights=w[flat, k], minlength=len(seen)) for k in range(5)], axis=1) + np.tensordot(edge, beside, 1)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - truth) * weight
        g_w = np.stack([np.bincount(flat, weights=error[owner, k], minlength=len(column)) for k in range(5)], axis=1) + options.decay / len(column) * w
        g_e = (beside * error[None]).sum(axis=(1, 2)) + options.decay * (edge - prior)
        for value, g, m, v in ((w, g_w, moments[0], moments[1]), (edge, g_e, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value -= options.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        np.clip(edge, 0, 2 * prior, out=edge)
    return Field({f: w[k] for f, k in column.items()}, float(edge[1]), float(edge[2]), float(edge[0]))


EXAMPLE_DDL = "doc_id long, ordinary array<array<long>>, sure array<array<long>>, labels array<int>, edges array<array<int>>"


def fit(docs: DataFrame, options: Options = Options()) -> Field:
    """A field fitted on a bounded sample of documents; the prior where they hold no span at all.

    Ids are chosen first, by a search in the JVM; features are made where the texts lie, and
    the driver sees hashes of at most ``nodes`` tokens of ``documents`` documents.
    """
    told = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(reduce(or_, [F.contains("text", F.lit(c)) for c in "@0123456789"]))  # on the bytes, without copies
    ids = [(r[0],) for r in told.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.documents).collect()]
    few = docs.sparkSession.createDataFrame(ids, "doc_id long")
    schema = pa.schema([("doc_id", pa.int64()), ("ordinary", pa.list_(pa.list_(pa.int64()))), ("sure", pa.list_(pa.list_(pa.int64()))), ("labels", pa.list_(pa.int32())), ("edges", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_nothing()
        for batch in common.narrow_batches(batches):
            found = [(i, e) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) if (e := example(t, options))]
            yield common.batch_of(schema, [[i for i, _ in found], *[[e[k] for _, e in found] for k in range(4)]])

    rows = told.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(run, EXAMPLE_DDL).collect()
    return learn([(r["ordinary"], r["sure"], r["labels"], r["edges"]) for r in sorted(rows, key=lambda r: r["doc_id"])], options)


def all_spans(text: str, field: Field = PRIOR) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, then start; places count code points."""
    base = base_spans(text)
    spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, field)]
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
SPANS_DDL = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"


def find_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and the spans of every row, by a field that is fitted on the rows themselves if none is given.

    A null or empty text has none; a text of any length is searched whole, and runs of digits
    or letters of any length take linear time; of overlapping doubtful tokens the better
    supported, then the longer, then the earlier one counts; a null doc_id stays null;
    repeated rows give equal spans; extra columns are not read; an empty table gives no rows.
    """
    field = fit(docs) if field is None else field
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_nothing()
        for batch in common.narrow_batches(batches):
            found = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in all_spans(t, field)] for t in batch["text"].to_pylist()]
            yield common.batch_of(schema, [batch["doc_id"], found])

    return common.id_and_text(docs).mapInArrow(run, SPANS_DDL)


def redact(text: str, field: Field = PRIOR) -> str:
    """The text with every span, or run of overlapping spans, replaced by its kind in brackets."""
    parts, at = [], 0
    merged: list[list] = []
    for kind, a, b, _ in sorted(all_spans(text, field), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (null stays null, empty stays empty) and ``n_chars``,
    where there is one, counted anew.

    Every row stays, with all its columns, rows without a doc_id and repeated rows too; texts of
    any length are redacted whole; where spans overlap the earliest names the kind, of those that
    begin together the longest; an empty table stays empty.  The field is fitted as by ``find_spans``.
    """
    field = fit(docs) if field is None else field
    names = docs.columns
    changed = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_nothing()
        for batch in common.narrow_batches(batches):
            columns = {n: batch[n] for n in names}
            texts = [None if t is None else redact(t, field) for t in batch["text"].to_pylist()]
            columns["text"] = pa.array(texts, type=pa.string())
            if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                columns["n_chars"] = pa.array([c if t is None else len(t) for c, t in zip(batch["n_chars"].to_pylist(), texts, strict=True)], type=columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return common.text_batches(docs).mapInArrow(run, changed)


def _written(spans: str) -> str:
    return f"concat_ws(',', transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)))"


def span_digests(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and digests of the spans, in the query's form; rows as by ``find_spans``."""
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    digest = F.expr(f"sha2({_written('filter(spans, s -> s.base)')}, 256)").alias("base_sha256")
    return find_spans(docs, field).select("doc_id", *counts, digest, F.expr(_written("spans")).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return span_digests(common.table(spark, sf_dir, "documents"))
