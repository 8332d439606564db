"""Near-duplicates against all pairs of exact sets."""

import random

import numpy as np
import pytest

from quiverspark.llm import near_dup
from tests.llm.helpers import LONG, empty, frame, prose, shuffled_bytes, tricky


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset([tuple(words)] if 0 < len(words) < n else [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]) if words else frozenset()


def brute(rows, threshold=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids, up = sorted(sets), {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def corpus(seed=3):
    rng, rows, i = random.Random(seed), [], 0
    passage = prose(rng, 30)
    for _ in range(25):
        base = prose(rng, rng.randint(4, 200)).split()
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40, len(base) // 20])):
                words[rng.randrange(len(words))] = "changed"
            rows.append((i, (passage + " " if rng.random() < 0.2 else "") + " ".join(words)))
            i += 1
    return rows + [(i, "One two THREE four"), (i + 1, "one  two\nthree four"), (i + 2, "one two three")]


@pytest.mark.parametrize("block", [512, 4])
def test_groups_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus()
    got = near_dup.near_duplicates(frame(spark, [(i, t, "en") for i, t in rows])).collect()
    wanted = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len(set(wanted.values())) < len(wanted)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 32)
    rng = random.Random(9)
    base = prose(rng, 150).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    got = near_dup.near_duplicates(frame(spark, [(i, t, "en") for i, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)


def near_copies(n, seed=9, words=150, changes=3):
    rng = random.Random(seed)
    base = prose(rng, words).split()
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, changes)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        yield i, " ".join(copy)


def test_rows_of_a_large_group_grow_with_its_copies(spark, monkeypatch):
    """A group of m near copies is contracted: the rows that are dealt grow like m, not like its square."""
    monkeypatch.setattr(near_dup, "BLOCK", 32)
    whole, dealt = near_dup.grouped, []
    monkeypatch.setattr(near_dup, "grouped", lambda df, keys, n: dealt.append(df.count()) or whole(df, keys, n))
    sums = []
    for m in (200, 800):
        dealt.clear()
        rows = list(near_copies(m, words=400))
        got = near_dup.near_duplicates(frame(spark, [(i, t, "en") for i, t in rows])).collect()
        if m == 200:
            assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)
        assert {r["component_id"] for r in got} == {0}
        sums.append(sum(dealt))
    assert sums[1] < 6 * sums[0]


def test_passes_over_the_documents_do_not_follow_the_rounds(spark, monkeypatch):
    """Texts of crowded buckets are set aside once; rounds of contraction read those, not all documents."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "MEMBERS", 4)
    whole, linked, read, rounds = near_dup.common.with_possible, near_dup.linked_blocks, [], []
    monkeypatch.setattr(near_dup.common, "with_possible", lambda rows, *a, **k: read.append(rows.count()) or whole(rows, *a, **k))
    monkeypatch.setattr(near_dup, "linked_blocks", lambda *a: rounds.append(1) or linked(*a))
    rows = [*near_copies(160, changes=6), *((1000 + i, prose(random.Random(i), 60)) for i in range(100))]
    got = near_dup.near_duplicates(frame(spark, [(i, t, "en") for i, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)
    assert len(rounds) > 1 and sum(n == len(rows) for n in read) == 2


def test_crowded_buckets_of_texts_that_are_not_linked(spark, monkeypatch):
    """Classes that share bands but few links, with chains and pairs among them."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(4)
    passage = prose(rng, 100)
    rows = [(i, passage + " " + prose(rng, 30, f"q{i}")) for i in range(60)]
    rows += [(100 + i, t + (" and more" if i % 2 else "")) for i, (_, t) in enumerate(rows[::6])]
    rows += [(200 + i, t) for i, t in near_copies(40, changes=8)]
    got = near_dup.near_duplicates(frame(spark, [(i, t, "en") for i, t in rows]), threshold=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 80)


def test_odd_rows(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(tricky(spark)).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[5][1:] == (5, True) and got[6][1:] == (5, False) and got[None][1:] == (None, True)
    assert got[4][0] == len(shingles(LONG))
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    two = frame(spark, [(8, "the same id with a first text", "en"), (8, "another text that has this id", "en"), (3, "another text that has this id", "en")])
    assert {r["component_id"] for r in near_dup.near_duplicates(two).collect()} == {3}
    kept = near_dup.deduplicated(tricky(spark))
    assert kept.columns == tricky(spark).columns and 6 not in {r["doc_id"] for r in kept.collect()} and kept.count() == 8
    with pytest.raises(ValueError):
        near_dup.near_duplicates(two, threshold=50)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.85, 0.95):
        found = []
        for _ in range(40):
            both, rest = rng.integers(0, 1 << 62, 300, dtype=np.uint64), rng.integers(0, 1 << 62, 600, dtype=np.uint64)
            n = int(300 / share - 300) // 2
            sets = np.concatenate((both, rest[:n])), np.concatenate((both, rest[n : 2 * n]))
            bits = [near_dup.pack_bits(near_dup.minima(s)).view("<u8")[None] for s in sets]
            found.append(near_dup.estimate(*bits)[0])
        truth = 300 / (300 + 2 * n)
        assert abs(np.mean(found) - truth) < 4 * np.sqrt(truth * (1 - truth) / near_dup.HASHES / 40) * 16 / 15 + 0.01


def test_texts_that_stay_are_not_shuffled(spark, no_broadcasts):
    """Only texts to be confirmed, and rows that may go, move; here 20 of 300 have a partner."""
    rng = random.Random(9)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(2000)) for _ in range(290)]
    texts += [f"{t} and more" for t in texts[:10]]
    docs = frame(spark, [*((i, t, "en") for i, t in enumerate(texts)), (None, texts[0], "en"), (300, None, "en")]).repartition(4).cache()
    assert docs.count() == 302
    whole, kept = shuffled_bytes(spark, lambda: docs.repartition(3).write.format("noop").mode("overwrite").save()), []
    moved = shuffled_bytes(spark, lambda: kept.extend(near_dup.deduplicated(docs).select("doc_id", "text").collect()))
    docs.unpersist()
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in kept if r[1] is not None) == sorted([(-1, texts[0]), *enumerate(texts[:290])]) and len(kept) == 292
    assert moved < 0.7 * whole
