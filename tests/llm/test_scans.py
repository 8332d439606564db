"""Personal data, licenses, nearest neighbours, and the pipeline."""

import hashlib
import random
import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiverspark.llm import ann, licenses, near_dup, packing, pii, quality, toxicity
from tests.llm.helpers import empty, frame, tricky

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((kind, m.start(), m.end()))
    return found


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "x", "1", "4111111111111111", " ", "-", "+1 (555) 010-9999", "10.0.0.1", "256.1.1.1", "é", "%", "b-c.d", "+", "("]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)
    spans = pii.all_spans(text)
    assert [s[:3] for s in spans if s[3]] == brute_spans(text)
    assert all(0 <= a < b <= len(text) for _, a, b, _ in spans)


def test_the_field_adds_what_the_patterns_lose():
    text = "call +1 (826) 555-4081 190.137.223.204 now, mail joe.doe77@x.org; joe.doe77 was here; nothing 123 456"
    added = [(k, text[a:b]) for k, a, b, base in pii.all_spans(text) if not base]
    assert ("phone", "+1 (826) 555-4081") in added and ("email", "joe.doe77") in added and len(added) == 2
    cards = "7536784127813051 4111111111111111"
    assert [(k, cards[a:b]) for k, a, b, _ in pii.all_spans(cards)] == [("card", "4111111111111111")]
    assert pii.all_spans("Version 2.0 of 2024-01-02, 1234567890123456 and 12345") == []
    assert pii.redact(text).startswith("call [PHONE] [IP] now, mail [EMAIL]; [EMAIL] was")


@pytest.mark.parametrize("n", [1, 2, 4, 50, 2000])
@pytest.mark.parametrize("first,token,kind", [("mail joe.doe77@x.org", "joe.doe77", "email"), ("call +1 415 555 1234", "1 415 555 1234", "phone"), ("call +1 (826) 555-4081 190.137.223.204", "1 826 555 4081", "phone")])
def test_the_field_finds_every_repeat(n, first, token, kind):
    far = " " + "nothing of note in here " * 4
    for parts in ([first] + [token] * n, [token] * n + [first], [token] * (n // 2) + [first] + [token] * (n - n // 2)):
        text = far.join(parts)
        found = [text[a:b] for k, a, b, base in pii.all_spans(text) if k == kind and not base]
        assert found.count(token) == n
    # repeats alone are no evidence
    assert pii.all_spans(far.join([token] * n)) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["0", "255", "256", "300", "0007", "0" * 5000, ".", "..", " ", "x", "1.2.3.4"]), max_size=12).map("".join))
def test_dotted_numbers(text):
    fits = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    wanted = [m.span() for m in re.finditer(PATTERNS["ip"], text) if all(map(fits, m.group().split(".")))]
    assert pii.addresses(text) == wanted


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", " @ ", "@", "(at)", " [at] ", ".", "(dot)", " ", "-", "!"]), max_size=10).map("".join))
def test_near_emails(text):
    pattern = r"[A-Za-z0-9._%+-]+(?: ?@ ?| ?[\[(]at[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)*"
    assert pii.near_emails(text) == [m.span() for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("run", ["0" * 5000 + ".1.1.1", "1" * 1_000_000, "Q" * 1_000_000, "1." * 300_000, "+1" + "(" * 1_000_000, "a." * 300_000, " ".join(f"joe.doe{i}@x.org" for i in range(3000))])
def test_very_long_runs_take_linear_time(run):
    began = time.time()
    spans = pii.all_spans("write to ann.lee4@x.org " + run)
    assert ("email", 9, 23, True) in spans and time.time() - began < 3


def test_loopy_messages_on_a_tree_are_exact():
    rng = np.random.default_rng(1)
    e, pairs, w = rng.normal(0, 1, (3, 5)), np.array([[0, 1], [1, 2]]), np.array([0.7, 1.3])
    p = np.zeros((3, 5))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                v = np.exp(e[0, a] + e[1, b] + e[2, c] + w[0] * (a == b) + w[1] * (b == c))
                p[0, a] += v
                p[1, b] += v
                p[2, c] += v
    assert np.allclose(pii.beliefs(e, pairs, w), p / p.sum(axis=1, keepdims=True), atol=1e-3)
    pairs, _ = pii.skip_edges(["same"] * 100)
    assert len(pairs) == 198  # each with the next by content and by likeness, not with all


def spoken(rng, kind):
    number = f"{rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"
    return {"phone": f"please call +1 {number} today", "bare": f"please call 1 {number} today", "order": f"order no {rng.randint(10**7, 10**8)} was sent", "part": f"order no 1 {number} was sent"}[kind]


def test_the_field_learns_from_found_spans(spark):
    """Calls with a plus sign are found by their pattern and teach what a call without one looks like."""
    rng = random.Random(3)
    texts = [spoken(rng, "phone" if i % 2 else "order") for i in range(160)]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    field = pii.fit(docs)
    for _ in range(20):
        bare, part = spoken(rng, "bare"), spoken(rng, "part")
        assert pii.all_spans(bare) == [] and [(k, bare[a:b]) for k, a, b, _ in pii.all_spans(bare, field)] == [("phone", bare[12:-6])]
        assert [s for s in pii.all_spans(part, field) if s[0] == "phone"] == []
    assert pii.fit(empty(spark)) == pii.PRIOR and pii.fit(frame(spark, [(1, "no numbers here", "en")])) == pii.PRIOR
    # learned evidence is bounded: plain tokens need a found one of their content
    assert pii.all_spans("call 12 or 4081 or 99 today", field) == []
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(docs.unionByName(frame(spark, [(1000, "please call 1 415 555 1234 today", "en")]))).collect()}
    assert got[1000] == "phone:12:26" and got[0] == ""


def test_weights_are_those_of_the_pseudo_likelihood():
    """The fitted weights are a better fit of the labelled nodes than the prior, by the objective worked out by hand."""
    rng = random.Random(5)
    examples = [pii.example(spoken(rng, "phone" if i % 2 else "order")) for i in range(100)]
    field = pii.learn(examples)

    def loss(field):
        total = 0.0
        for ordinary, _, labels, edges in examples:
            for i, y in enumerate(labels):
                logits = np.sum([field.weights.get(f, np.zeros(5)) for f in ordinary[i]], axis=0)
                for a, b, sort in edges:
                    if i in (a, b) and (other := labels[b if i == a else a]) >= 0:
                        logits = logits + (field.near, field.same, field.alike)[sort] * np.eye(5)[other]
                total -= logits[y] - np.log(np.exp(logits).sum())
        return total

    assert loss(field) < 0.2 * loss(pii.PRIOR)


def test_pii_tables(spark):
    docs = frame(spark, [(1, "a@b.co and 10.0.0.1", "en"), (2, None, "en"), (3, "clean", None)])
    got = {r["doc_id"]: r for r in pii.span_digests(docs).collect()}
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["spans"]) == (1, 1, "email:0:6,ip:11:19")
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:11:19").hexdigest() and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redacted(docs).collect()}
    assert clean == {1: ("[EMAIL] and [IP]", 16), 2: (None, None), 3: ("clean", 5)}
    assert pii.redacted(docs).columns == docs.columns
    assert pii.span_digests(tricky(spark)).count() == 9 and pii.span_digests(empty(spark)).count() == 0 and pii.redacted(empty(spark)).count() == 0


# --- licenses ----------------------------------------------------------------------------


def test_licenses(spark):
    mit = dict((i, t) for i, t in licenses.KNOWN if t.startswith("MIT"))["MIT"]
    changed = "Copyright (c) 2020 Some One\n© 2021 Another\n" + mit.replace("license", "licence").upper().replace(". ", " .\n") + "\n"
    docs = frame(spark, [(1, mit, "en"), (2, changed, "en"), (3, mit + " and more", "en"), (4, None, "en"), (5, "... !!", "en"), (6, "licensed under the apache licence, version 2.0", "en"), (None, mit, "en")])
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {i: r["license_id"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "Apache-2.0", None: "MIT"}
    assert got[4]["digest"] == got[5]["digest"] == hashlib.sha256(b"").hexdigest()
    own = licenses.known_digests(spark, [("X-1", "my own licence")])
    assert licenses.scan(frame(spark, [(1, "My Own License!", "en")]), own).first()["license_id"] == "X-1"
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(tricky(spark)).count() == 9


def test_licenses_at_every_wrap(spark):
    import textwrap

    heads = ["", "The {} License\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n", "Copyright 1999-2003, The Authors\n\n"]
    rows, wanted = [], {}
    for name, text in licenses.KNOWN:
        for width in range(60, 101) if len(text) > 200 and not text.startswith("MIT License") else ():
            for head in heads:
                wanted[len(rows)] = name
                body = "\n\n".join("\n".join(textwrap.wrap(x, width)) for x in text.split("\n\n"))
                rows.append((len(rows), head.format(name) + body.replace("1. ", "* ").replace("2. ", "(b) "), "en"))
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(frame(spark, rows)).collect()}
    assert len(got) > 1000 and {i for i in got if got[i] != wanted[i]} == set()


def test_long_licenses(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    folder = Path("/usr/share/common-licenses")
    if not all((folder / f).exists() for f in files):
        pytest.skip("no license texts here")
    texts = [(folder / f).read_text() for f in files]
    got = licenses.scan(frame(spark, [(k, t, "en") for k, t in enumerate(texts)] + [(100 + k, t[:-40], "en") for k, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {**dict(enumerate(files.values())), **{100 + k: None for k in range(len(files))}}


def test_license_sql_agrees(spark):
    docs = tricky(spark).unionByName(frame(spark, [(20 + i, t.replace("license", "Licence"), "en") for i, (_, t) in enumerate(licenses.KNOWN)] + [(50, "don’t “quote” – this — ok", "en")]))
    documents = docs.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    key = lambda r: str(r)
    none = lambda v: None if v is None or v != v else v
    wanted = sorted([(none(a), b, none(c)) for a, b, c in con.execute(licenses.OP7_SQL).fetchall()], key=key)
    got = sorted([(float(r[0]) if r[0] is not None else None, r[1], r[2]) for r in licenses.scan(docs).collect()], key=key)
    assert [(None if a is None else float(a), b, c) for a, b, c in wanted] == got


# --- nearest neighbours --------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query long, id long")


def brute_neighbours(rows, is_query, k):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in ok:
        if is_query(i):
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i)
            out[i] = [(j, x) for x, j in d[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (8, 16))
    rows = [(i, (centres[i % 8] + 0.3 * rng.normal(0, 1, 16)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one common vector
    df = vectors_of(spark, [(i, v, 0, 0) for i, v in rows])
    o = ann.Options(leaf=64, block=50, step=16, numbers_at_once=64 * 16)
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, o).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    wanted = brute_neighbours(rows, lambda i: i % 20 == 0, 10)
    assert set(got) == set(wanted) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.95 * 10 * len(wanted)
    assert [i for i, _ in got[1000]] == [i for i, _ in wanted[1000]]  # ties to smaller ids
    exact = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert abs(s - np.sqrt(((np.array(exact[q], np.float32).astype(float) - np.array(exact[i], np.float32).astype(float)) ** 2).sum())) < 1e-12


def test_vectors_that_take_no_part(spark):
    bad = [(100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [1.0]), (700, []), (None, [1.0, 2.0])]
    good = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])]
    df = vectors_of(spark, [(i, v, 0, 0) for i, v in bad + good])
    got = [tuple(r)[:3] for r in ann.nearest(df, F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(df.where("vec_id > 50"), F.col("id") % 100 == 0).count() == 0
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 4 + (i % 3 == 0) + 2 * (i % 50 == 1)).astype(np.float32).tolist()) for i in range(300)]
    got = {}
    for r in ann.nearest(vectors_of(spark, [(i, v, 0, 0) for i, v in rows]), F.col("id") % 20 == 1, ann.Options(trees=2, confidence=0.9999)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for d in (4, 5, 6, 7):
        alike = [(i, v) for i, v in rows if len(v) == d]
        for q, found in brute_neighbours(alike, lambda i: i % 20 == 1, 10).items():
            assert got.get(q, []) == [i for i, _ in found]


def clustered(rng, n, d=48, clusters=40, spread=0.2):
    return (rng.normal(0, 1, (clusters, d))[rng.integers(clusters, size=n)] + spread * rng.normal(0, 1, (n, d))).astype(np.float32).astype(np.float64)


def test_the_test_saves_verifications_at_the_asked_recall():
    rng = np.random.default_rng(6)
    x, o = clustered(rng, 4000), ann.Options()
    tree = ann.Tree.fit(x, len(x), o)
    queries = x[::40]
    found, verified = ann.visit_block(x, [np.array([i]) for i in range(len(x))], queries, np.arange(len(queries)), np.full(len(queries), np.inf), tree, o)
    assert verified < 0.2 * len(x) * len(queries)
    true = np.argsort(((queries[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :11]
    hits = sum(len(set(found[found["query"] == i]["id"]) & set(t)) for i, t in enumerate(true))
    assert hits >= 0.93 * true.size
    # more projections where they pay
    assert ann.chosen(rng.normal(0, 1, (2000, 256)), o) > ann.chosen(rng.normal(0, 1, (2000, 2)), o)


def test_blocks_go_to_their_own_visitors(spark, monkeypatch):
    """A block is copied once for each portion of the queries that visit it, not for each portion of all queries."""
    rng = np.random.default_rng(7)
    x = clustered(rng, 3000, d=16, clusters=30, spread=0.02)
    df = vectors_of(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(x)])
    written = {}
    whole = ann.write_table
    monkeypatch.setattr(ann, "write_table", lambda frame, name: written.setdefault(name + "2" * (name in written), whole(frame, name)))
    o = ann.Options(leaf=100, block=100, numbers_at_once=64 * 16)
    assert ann.nearest(df, F.col("id") % 10 == 0, o).count() == 3000
    blocks = written["placed"].groupBy("d", "leaf").count().count()
    copies = written["portions2"].agg(F.sum("portions")).first()[0]
    visits = written["visits2"].count()
    assert copies <= visits / 64 + written["portions2"].count() and visits < 0.5 * blocks * 300


def test_chi_square():
    assert abs(ann.chi_square_cdf(ann.chi_square_quantile(0.9, 8), 8) - 0.9) < 1e-9
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_the_sample_for_the_tree_does_not_grow_on_the_driver_with_the_tasks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (16_000, 32)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(16)
    classes = df.select(F.col("embedding").alias("vector"), F.xxhash64("embedding").alias("class"), F.size("embedding").alias("d"))
    o, status = ann.Options(sample=500), spark.sparkContext._jsc.sc().statusStore()

    def sent(run) -> tuple:
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(group := f"ann-{rng.integers(1 << 60)}", "")
        out = run()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return out, sum(status.lastStageAttempt(s).resultSize() for s in stages)

    got, bytes_sent = sent(lambda: ann.sample_of(classes, 32, len(x), o))
    wanted = classes.orderBy("class").limit(500).collect()
    assert (got == np.array([r["vector"] for r in wanted])).all()
    assert bytes_sent < 16 * 500 * 32 * 8 / 4  # a sample from each task would be the whole of that
    # and the whole search sends little more, though each task holds more rows than the sample
    _, whole = sent(lambda: ann.nearest(df, F.col("id") % 1000 == 0, o).collect())
    assert whole < 16 * 500 * 32 * 8 / 2
    assert ann.Options(sample_numbers=1 << 22).sampled(1 << 14) == 256


# --- the pipeline ------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = docs
    for (name, stage), same in zip(corpus_pipeline.STAGES[:-1], (toxicity.without_toxic(docs, labels), None, None, None)):
        before = kept
        kept = stage(spark, before, sf)
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema], name
        if same is not None:
            assert sorted(kept.select("doc_id").collect()) == sorted(same.select("doc_id").collect())
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        left = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "quality_rules":
            assert left == {r["doc_id"] for r in quality.verdicts(before, labels).where("kept").collect()}
        elif name == "near_duplicates":
            assert left == {r["doc_id"] for r in near_dup.near_duplicates(before, threshold=80).where("kept").collect()}
        elif name == "personal_data":
            assert {r["doc_id"]: r["text"] for r in kept.collect()} == {r["doc_id"]: pii.redact(r["text"]) for r in before.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.collect()}
    assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r)[:5] for r in packing.pack_digests(kept).collect())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_the_stages_take_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = tricky(spark)
    for name, stage in corpus_pipeline.STAGES:
        found, nothing = stage(spark, docs, sf), stage(spark, empty(spark), sf)
        assert nothing.count() == 0, name
        if name == "packing":
            assert found.count() >= 9 and found.where("length < 1").count() == 0
            continue
        assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema], name
        kept = [(r["doc_id"], r["score"], r["label"]) for r in found.collect()]
        assert set(kept) <= {(r["doc_id"], r["score"], r["label"]) for r in docs.collect()}
        ids = [i for i, *_ in kept]
        if name == "quality_rules":
            assert not {1, 2, 3} & set(ids)  # null, empty and blank
        elif name == "near_duplicates":
            assert ids.count(5) == 2 and 6 not in ids and None in ids and {1, 2, 3} <= set(ids)
        else:
            assert len(ids) == 9, name


def test_the_pipeline_joins_near_duplicates_from_80(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]  # 100 shingles; a changed word takes the 5 around it
    texts = {1: words, 2: [*words[:50], "x", *words[51:95], "y", *words[96:]], 3: [*words[:30], "x", *words[31:60], "y", *words[61:80], "z", *words[81:]]}
    docs = frame(spark, [(i, " ".join(w), "en") for i, w in texts.items()])
    # 1 and 2 share 90 of 110 shingles, 3 shares fewer than 0.8 with either
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}
    assert {r["doc_id"] for r in near_dup.near_duplicates(docs).where("kept").collect()} == {1, 2, 3}


def test_registered_queries():
    from quiverspark.llm import queries

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.mark.parametrize("stage", [quality.measured, lambda docs: pii.find_spans(docs, pii.PRIOR)])
def test_stages_let_go_of_what_earlier_ones_remember(stage, monkeypatch):
    """A worker outlives stages, so one that remembers nothing must not carry an earlier one's memory along."""
    common, tasks = quality.common, []

    class Texts:
        def mapInArrow(self, run, schema):
            tasks.append(run)

    monkeypatch.setattr(common, "id_and_text", lambda docs: Texts())
    stage(None)
    common.per_process("much", "", dict)
    assert sum(b.num_rows for b in tasks[0](iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", ""]})]))) == 2
    assert common._HELD[2] is None
