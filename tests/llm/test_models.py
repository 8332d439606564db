"""Trained operators: held-out accuracy, exact inference, and odd rows."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiverspark.llm import common, langid, quality, toxicity
from tests.llm.helpers import empty, frame, prose, shuffled_bytes, tricky

WORST = ["vilecrap", "scumbag", "lowlife"]


def labelled(spark, rows, column):
    return spark.createDataFrame([(i, y) for i, y in rows], f"doc_id long, {column} int")


@pytest.fixture(scope="module")
def toxic(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(600):
        words, bad = prose(rng, rng.randint(5, 60), "ge" if i % 3 == 0 else "").split(), i % 5 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(WORST) + rng.choice(["", ",", "%%"]))
        rows.append((i, " ".join(words), "de" if i % 3 == 0 else "en"))
        if i % 4 < 3:
            labels.append((i, int(bad)))
    return frame(spark, rows), labelled(spark, labels, "toxic"), {i: i % 5 == 0 for i in range(600)}


def test_toxicity_on_held_out_rows(spark, toxic):
    docs, labels, truth = toxic
    model = toxicity.fit(docs, labels, toxicity.Options(epochs=4))
    got = toxicity.score(docs, model).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum((r["predicted"] == 1) == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 480) < 15
    odd = toxicity.score(tricky(spark), model).collect()
    assert len(odd) == 9 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.score(docs.limit(5), toxicity.fit(docs, labelled(spark, [], "toxic"))).count() == 5
    assert toxicity.without_toxic(empty(spark), labels).count() == 0


def test_scores_do_not_depend_on_batches(toxic):
    docs, labels, _ = toxic
    model = toxicity.fit(docs, labels, toxicity.Options(epochs=1))
    texts = [r["text"] for r in docs.select("text").limit(50).collect()] + ["", "one", "vilecrap"]
    one = [toxicity.Scorer(model).logits([t])[0][0] for t in texts]
    scorer = toxicity.Scorer(model)
    assert np.allclose(one, scorer.logits(texts)[0], atol=1e-4)
    saved, toxicity.WORDS_AT_ONCE = toxicity.WORDS_AT_ONCE, 7
    try:
        assert np.allclose(one, scorer.logits(texts)[0], atol=1e-4)
    finally:
        toxicity.WORDS_AT_ONCE = saved


# --- language ----------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=6), st.integers(1, 4), st.integers(1, 6), st.integers(0, 1000))
def test_marginals_are_exact(lengths, labels, segment, seed):
    rng = np.random.default_rng(seed)
    n = sum(lengths)
    e, t = rng.normal(0, 2, (n, labels)), rng.normal(0, 2, (labels, labels))
    got, at = langid.marginals(e, np.array(lengths), t, segment), 0
    for size in lengths:
        if 0 < size <= 5:
            p = np.zeros((size, labels))
            for path in itertools.product(range(labels), repeat=size):
                w = np.log(np.exp(t[:, path[0]]).mean()) + sum(e[at + k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))
                for k, y in enumerate(path):
                    p[k, y] += np.exp(w)
            assert np.allclose(got[at : at + size], p / p.sum(axis=1, keepdims=True), atol=1e-8)
        at += size
    assert np.allclose(got, langid.marginals(e, np.array(lengths), t, 1000), atol=1e-8)


def test_languages_on_held_out_rows(spark):
    rng, rows = random.Random(6), []
    stems = {"aa": "ka", "bb": "ölo", "cc": "ze"}
    for i in range(300):
        lang = sorted(stems)[i % 3]
        rows.append((i, prose(rng, rng.randint(8, 60), stems[lang]), lang))
    docs = frame(spark, rows)
    model = langid.fit(docs, langid.Options(documents=60, sequences=300, epochs=2))
    held = [r for r in langid.predict(docs, model).collect() if r["held_out"]]
    assert len(held) > 50 and all(r["lang_pred"] == sorted(stems)[r["doc_id"] % 3] and 0.5 < r["score"] <= 1 for r in held)
    mixed = prose(rng, 30, "ka") + " " + prose(rng, 20, "ze")
    p, _, _ = langid.Labeller(model).words([mixed])
    assert (p[:30].argmax(axis=1) == 0).mean() > 0.95 and (p[30:].argmax(axis=1) == 2).mean() > 0.95
    odd = {r["doc_id"]: r for r in langid.predict(tricky(spark), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (1, 2, 3)) and odd[5]["lang_pred"] in stems
    numbers = langid.predict(frame(spark, [(1, "12 34 !!", "aa")]), model).first()
    assert numbers["lang_pred"] == "und"
    assert langid.predict(empty(spark), langid.fit(empty(spark))).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty(spark))).collect()} == {"und"}


# --- quality -----------------------------------------------------------------------------


def brute_counts(text):
    import re
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered, lines, again = Counter(windows), set(), set(), 0
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(k, k + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x0c\r|é#\x1f ", max_size=120))
def test_counts(text):
    assert quality.statistics(text)[0] == brute_counts(text)


@pytest.fixture(scope="module")
def mixed(spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(500):
        text, good = prose(rng, rng.randint(25, 150)).capitalize() + ".", i % 6 != 0
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 12 else " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en"))
        if i % 5:
            labels.append((i, int(good)))
    return frame(spark, rows), labelled(spark, labels, "quality")


def test_verdicts(spark, mixed):
    docs, labels = mixed
    got = {r["doc_id"]: r for r in quality.verdicts(docs, labels).collect()}
    assert all(got[i]["kept"] == (i % 6 != 0) for i in range(0, 500, 5))  # rows without a label
    assert all([got[i][c] for c in quality.COUNTS] == brute_counts(t) for i, t in docs.select("doc_id", "text").limit(40).collect())
    kept = quality.rule_abiding(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i in got if got[i]["kept"]}
    odd = {r["doc_id"]: r for r in quality.verdicts(tricky(spark), labels).collect()}
    assert all(odd[i]["base_failed"] and not odd[i]["kept"] and odd[i]["n_words"] == 0 for i in (1, 2, 3))
    assert quality.verdicts(empty(spark), labels).count() == 0
    plain = quality.verdicts(docs, labelled(spark, [], "quality")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in plain)


def test_the_threshold_rests_on_all_labelled_rows(spark):
    rng, texts = random.Random(4), []
    for i in range(4200):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(30, 90))]
        marked = rng.random() if i % 7 == 0 or i % 16 == 0 else 0
        texts.append(" ".join(w + "!" * (rng.random() < marked) + "%" * (rng.random() < marked) for w in words))
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = sorted(quality.verdicts(docs, labelled(spark, [(i, int(i % 16 != 0)) for i in range(4200)], "quality"), quality.Options(keep=0.95)).collect())
    assert not any(r["base_failed"] for r in got)
    scores = np.array([r["anomaly"] for r in got])
    fine, bad = np.sort(np.delete(scores, np.s_[::16])), scores[::16]
    limit = fine[-(-95 * len(fine) // 100)]
    threshold = (limit + bad[bad > limit].min()) / 2 if (bad > limit).any() else 1.0
    assert [r["kept"] for r in got] == (scores <= threshold).tolist()


@pytest.mark.parametrize("rank", [0, 1, 700, 2998, 2999])
def test_ranks_are_exact(spark, rank):
    values = np.random.default_rng(2).beta(2, 9, 3000).round(5)
    assert quality._ranked(spark.createDataFrame([(float(v),) for v in values], "anomaly double"), rank) == np.sort(values)[rank]


def test_forest_scores_strangers_higher():
    rng = np.random.default_rng(0)
    rows = rng.normal(0, 0.1, (1000, 3))
    forest = quality.Forest(rows, quality.Options(trees=64, rows_a_tree=128))
    assert forest.score(np.array([[3.0, 3, 3]]))[0] > np.quantile(forest.score(rows), 0.99)
    assert quality.Forest(rows[:0], quality.Options()).score(rows[:2]).tolist() == [0, 0]
    assert abs(float(quality.expected_path(256)) - 10.24) < 0.1


def test_the_forward_pass_by_hand(toxic):
    docs, labels, _ = toxic
    model = toxicity.fit(docs, labels, toxicity.Options(epochs=1))
    texts = [r["text"] for r in docs.select("text").limit(20).collect()] + ["", "one", "vilecrap two"]
    known = {int(k): i for i, k in enumerate(model.keys)}
    for text, logit in zip(texts, toxicity.Scorer(model).logits(texts)[0], strict=True):
        words = [[known.get(b, 0) for b in toxicity.buckets_of(w)] for w in text.lower().split()]
        embedded = [sum(model.table[r].astype(float) for r in rows) for rows in words]
        total = model.offset
        for k, (width, kernel) in enumerate(zip(toxicity.WIDTHS, model.kernels, strict=True)):
            for f in range(model.options.filters):
                place = k * model.options.filters + f
                values = [sum(embedded[a + j] @ kernel[j][:, f] for j in range(width)) for a in range(len(words) - width + 1)]
                total += max(0.0, max(values, default=-1e9) + model.bias[place]) * model.dense[place]
        assert abs(total - logit) < 1e-3


def test_the_sample_is_bounded_in_words(spark, toxic):
    docs, labels, _ = toxic
    whole = toxicity.labelled_sample(docs, labels, "toxic", toxicity.F.lit(True), {1: 30, 0: 50}, 10_000)
    assert [sum(1 for r in whole if r[1] == y) for y in (1, 0)] == [30, 50]
    short = toxicity.labelled_sample(docs, labels, "toxic", toxicity.F.lit(True), {1: 30, 0: 50}, 20)
    assert len(short) > 30 and all(n <= 20 for *_, n in short)  # longer texts make room for the next ones
    small = toxicity.fit(docs, labels, toxicity.Options(epochs=1, words=300))
    assert 1 < len(small.keys) < len(toxicity.fit(docs, labels, toxicity.Options(epochs=1)).keys)


def test_path_lengths_by_hand():
    """The anomaly of each row from its way down every tree, one node at a time."""
    rng = np.random.default_rng(3)
    rows = rng.beta(1, 6, (300, 4)).round(2)
    forest = quality.Forest(rows, quality.Options(trees=9, rows_a_tree=64))
    expected = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    for x, anomaly in zip(rows[:60], forest.score(rows[:60]), strict=True):
        lengths = []
        for feature, split, left, length in forest.trees:
            node, depth = 0, 0
            while feature[node] >= 0:
                node, depth = left[node] + int(x[feature[node]] >= split[node]), depth + 1
            assert length[node] >= depth  # what lies below a cut tree is estimated
            lengths.append(length[node])
        assert abs(anomaly - 2 ** (-np.mean(lengths) / expected(64))) < 1e-9
    # a leaf's length is its depth and the expected path of the rows that ended there
    one = quality.Forest(rows[:8], quality.Options(trees=1, rows_a_tree=8))
    feature, split, left, length = one.trees[0]
    ends = {}
    for x in rows[:8]:
        node, depth = 0, 0
        while feature[node] >= 0:
            node, depth = left[node] + int(x[feature[node]] >= split[node]), depth + 1
        ends.setdefault(node, []).append(depth)
    assert all(abs(length[node] - (d[0] + expected(len(d)))) < 1e-6 for node, d in ends.items())


def test_toxicity_learns_from_every_labelled_row(spark):
    """More rows than any sample of 7000: each bucket of four fitted documents is known, by counts of all of them."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(12_000):
        bad = i % 9 == 0
        words = [rng.choice(["river", "stone", "garden", "window"]) for _ in range(6)] + [f"rare{chr(97 + i // 24 // 26)}{chr(97 + i // 24 % 26)}x", f"vile{chr(97 + i % 7)}" if bad else "kind"]
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    docs, labels = frame(spark, docs).repartition(5), labelled(spark, labels, "toxic")
    F = toxicity.F
    fitted = {r[0] for r in docs.where((toxicity.common.fold_of("doc_id", 5) != 0) & (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) != 4)).select("doc_id").collect()}
    shown = {}
    for r in docs.select("doc_id", "text").collect():
        for b in {b for w in r["text"].split() for b in toxicity.buckets_of(w)} if r["doc_id"] in fitted else ():
            shown[b] = shown.get(b, 0) + 1
    model = toxicity.fit(docs, labels, toxicity.Options(epochs=2))
    assert len(fitted) > 7000 and set(model.keys.tolist()) == {0} | {b for b, n in shown.items() if n >= 4}
    got = toxicity.score(docs, model).where("held_out").select("doc_id", "predicted").collect()
    assert len(got) > 2000 and all(r["predicted"] == (r["doc_id"] % 9 == 0) for r in got)
    # a smaller model keeps what tells of the label
    small = toxicity.fit(docs, labels, toxicity.Options(epochs=0, buckets=40))
    assert 10 < len(small.keys) <= 41
    assert all(toxicity.buckets_of(f"vile{c}")[0] in small.keys for c in "abcdefg")


def test_toxicity_moves_labelled_texts_alone_and_once(spark, no_broadcasts):
    """Texts without a label, here nine in ten, stay where they lie; the others are shuffled once to their shards."""
    rng = random.Random(12)
    docs = frame(spark, [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(250)), "en") for i in range(2000)]).repartition(4).cache()
    labels = labelled(spark, [(i, i % 20 // 10) for i in range(0, 2000, 10)] + [(i, None) for i in range(1, 2000, 10)], "toxic")
    assert docs.count() == 2000
    whole = shuffled_bytes(spark, lambda: docs.repartition(3).write.format("noop").mode("overwrite").save())
    told = labels.where("toxic IS NOT NULL").withColumnRenamed("toxic", "label")
    made = []
    moved = shuffled_bytes(spark, lambda: made.append(toxicity.shards_of(docs.select("doc_id", "text", "lang"), told, 200)))
    assert sum(len(labels) for r in made[0].collect() for labels in [r["labels"]]) == 200
    fitted = shuffled_bytes(spark, lambda: toxicity.fit(docs, labels, toxicity.Options(epochs=0)))
    docs.unpersist()
    assert 0.08 * whole < moved < 0.25 * whole
    assert fitted < 0.4 * whole


def test_possible_ids_are_never_missed(spark):
    ids = spark.range(-900, 900, 3).withColumnRenamed("id", "doc_id").union(spark.sql("SELECT 9223372036854775807L UNION ALL SELECT null"))
    docs = spark.range(-20_000, 20_000).select(common.F.col("id").alias("doc_id"), common.F.lit("x").alias("number0"), common.F.lit("y").alias("a.`b"))
    docs = docs.union(spark.sql("SELECT 9223372036854775807L, 'x', 'y' UNION ALL SELECT null, 'x', 'y'"))
    got = common.with_possible(docs, ids, 601)
    assert got.columns == [*docs.columns, "possible"] and got.count() == 40_002
    yes = {r[0] for r in got.where("possible").select("doc_id").collect()}
    assert yes >= {*range(-900, 900, 3), 9223372036854775807} and None not in yes and len(yes) < 601 + 40_000 / 10
    assert got.where("possible IS NULL OR doc_id IS NULL AND possible").isEmpty()
    assert common.with_possible(docs, ids.limit(0), 0).where("possible").isEmpty()
    few, common.FILTER_BITS = common.FILTER_BITS, 1 << 9  # more ids than bits: everything may be among them
    try:
        assert {r[0] for r in common.with_possible(docs, spark.range(30_000).withColumnRenamed("id", "doc_id"), 30_000).where("possible").select("doc_id").collect()} >= set(range(20_000))
    finally:
        common.FILTER_BITS = few
