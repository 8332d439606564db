"""Token store, packing, SentencePiece: against the libraries themselves."""

import random
import time
import zlib

import numpy as np
import pytest

from quiverspark.llm import common, packing, spm, token_store
from quiverspark.plans.workspace import new_path
from tests.llm.helpers import LONG, empty, frame, prose, tricky

public_tokenizers = pytest.importorskip("public_tokenizers")


def library(file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_encoding_is_the_librarys(file):
    rng, truth = random.Random(1), library(file)
    alphabet = "  \n\t.,'ab%é1\x1c　¶^ΣIİ́sre!<|endoftext|>​"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choices(" \nab.'s^¶", k=rng.randint(0, 12))) for _ in range(3000)] + [LONG, "<|endoftext|> a", prose(rng, 500)]
    ids = common.TokenIds(file)
    assert ids.encode(texts) == [truth(t).tobytes() for t in texts]
    ids.memo_words = 10
    assert ids.encode(texts[:500]) == [truth(t).tobytes() for t in texts[:500]] and len(ids.memo) > 0  # a full memo


def test_token_store(spark):
    docs = tricky(spark)
    truth = library("word_bpe_49k.json")
    store = token_store.TokenStore.write(docs, new_path(spark, "store"))
    got = sorted(map(tuple, store.digests().select("doc_id", "copy", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[2])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start, copies, wanted = 0, {}, []
    for i, text in rows:
        ids = np.append(truth(text), np.uint32(1)).astype("<u4")
        copies[i] = copies.get(i, -1) + 1
        wanted.append((i, copies[i], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == wanted
    asked = spark.createDataFrame([(5, 1), (4, 0), (99, 0), (5, 9)], "doc_id long, copy int")
    found = {(r["doc_id"], r["copy"]): np.frombuffer(r["ids"], "<u4") for r in store.lookup(asked).collect()}
    assert set(found) == {(5, 1), (4, 0)} and (found[(4, 0)][:-1] == truth(LONG)).all()
    nothing = token_store.TokenStore.write(empty(spark), new_path(spark, "store"))
    assert nothing.digests().count() == 0 and nothing.lookup(asked).count() == 0


def test_blocks_end_and_go_on(spark, monkeypatch):
    docs = frame(spark, [(i, prose(random.Random(i), 40), "en") for i in range(200)])
    whole = token_store.TokenStore.write(docs, new_path(spark, "store"))
    assert whole.digests().count() == 200
    starts = sorted((r["start"], r["n_tokens"]) for r in whole.digests().collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_a_lookup_opens_the_folders_of_its_keys(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_KEYS", 4)
    monkeypatch.setattr(token_store, "SEGMENTS_A_PART", 2)
    docs = frame(spark, [(i, prose(random.Random(i), 40), "en") for i in range(200)])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        store = token_store.TokenStore.write(docs, new_path(spark, "store"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert store.segments() == 50 and store.payload.select("shard").distinct().count() > 4
    one = store.lookup(spark.createDataFrame([(77, 0)], "doc_id long, copy int"))
    files = one.inputFiles()
    assert len([f for f in files if "/payload/" in f]) == 1 and not [f for f in files if "/index/" in f]
    truth = library("word_bpe_49k.json")(docs.where("doc_id = 77").first()["text"])
    assert (np.frombuffer(one.first()["ids"], "<u4")[:-1] == truth).all()
    parts = store._folders("index", "part", [3], token_store.INDEX_DDL)
    assert parts.count() <= 2 and {r["part"] for r in parts.select("part").collect()} == {3}
    monkeypatch.setattr(token_store, "FEW_KEYS", 0)
    joined = store.lookup(spark.createDataFrame([(77, 0), (78, 0), (1000, 0)], "doc_id long, copy int"))
    assert {r["doc_id"] for r in joined.collect()} == {77, 78}


def test_rows_of_one_id_spread_over_shards(spark):
    docs = frame(spark, [(None if i % 2 else 5, "one text" if i % 3 else f"text {i}", "en") for i in range(600)] + [(9, "last", "en")])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        store = token_store.TokenStore.write(docs, new_path(spark, "store"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = store.directory().collect()
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) > 1
    for i, n in ((None, 300), (5, 300), (9, 1)):
        assert sorted(r["copy"] for r in rows if r["doc_id"] == i) == list(range(n))
    got = sorted((r["start"], r["n_tokens"]) for r in store.digests().collect())
    assert len(got) == 601 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_perfect_hash():
    keys = token_store.key_hashes(np.arange(5000), np.zeros(5000))
    perfect = token_store.PerfectHash.build(keys)
    assert sorted(perfect.slots(keys)) == list(range(5000)) and len(perfect.bits) < 4 * 5000
    assert token_store.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([7, 7], dtype=np.uint64))


def test_packing(spark):
    docs = tricky(spark)
    truth = library("byte_bpe_50k.json")
    pieces = packing.pack_digests(docs).collect()
    assert sorted(p["sequence_id"] for p in pieces) == list(range(len(pieces)))
    assert all(p["offset"] == 0 and p["length"] in [1 << k for k in range(12)] for p in pieces)
    wanted = []
    for r in docs.collect():
        ids = np.append(truth(r["text"] or ""), np.uint32(1)).astype("<u4")
        at = 0
        for n in packing.binary_lengths(len(ids), 2048):
            wanted.append((r["doc_id"], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    key = lambda r: (r[0] is not None, r)
    assert sorted([tuple(p)[:5] for p in pieces], key=lambda r: str(r)) == sorted(wanted, key=lambda r: str(r))
    by_length = sorted((p["sequence_id"], p["length"]) for p in pieces)
    assert [n for _, n in by_length] == sorted(n for _, n in by_length)  # bucket by bucket
    assert packing.pack_digests(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(docs, max_tokens=1000)
    path = new_path(spark, "packed")
    assert packing.pack(docs, path).count() == len(pieces)
    assert key(wanted[0])


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 7000])
def test_binary_lengths(n):
    lengths = packing.binary_lengths(n, 2048)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and all(k & (k - 1) == 0 for k in lengths)


# --- SentencePiece -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return spm.Pieces(spm.MODEL)


def test_viterbi_is_the_librarys_unigram_search(pieces):
    """The library under its unigram rule, on lines without characters that no piece holds."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(public_tokenizers.path(spm.MODEL), "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.score < spm.NO_CHOICE:
            p.score = -40000.0
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = lambda ids: sum(pieces.score[pieces.names[i]][0] for i in ids)
    rng, same = random.Random(4), 0
    for _ in range(300):
        text = prose(rng, 12)
        mine, theirs = np.frombuffer(pieces.encode(text), "<u4").tolist(), library.encode(text)
        assert score(mine) == score(theirs)
        same += mine == theirs
    assert same > 200  # the rest are ties


def test_streaming_commits_early_and_agrees(pieces):
    rng = random.Random(2)
    for text in [prose(rng, 50), "x" * 500, "é漢😀\n" * 60, "a  b   c\n\n d", spm.MARK * 40 + "end", "".join(rng.choices("abcdefgh", k=4000))]:
        marked = spm.MARK + text.replace(" ", spm.MARK)
        portions = list(pieces.stream([marked[k : k + 7] for k in range(0, len(marked), 7)]))
        ids = [i for p in portions for i in p]
        assert ids == np.frombuffer(pieces.encode(text), "<u4").tolist()
        assert pieces.decode(ids) == text.replace(spm.MARK, " ")
    assert len(list(pieces.stream([spm.MARK + prose(rng, 2000)]))) > 20


def test_sentencepiece_table(spark, pieces):
    docs = tricky(spark)
    ids = spm.encoded(docs)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in spm.decoded(ids).collect())
    assert back == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert spm.encoded(empty(spark)).count() == 0 and spm.decoded(spm.encoded(empty(spark))).count() == 0


def test_long_stretches_commit_early_and_take_linear_time(pieces):
    for text in ("ab" * 150_000, "q" * 150_000, "nospaceshere" * 12_000):
        began = time.time()
        out = [i for part in pieces.stream([text]) for i in part]
        assert pieces.decode(out) == text and time.time() - began < 20
    parts = list(pieces.stream(["the", " cat".replace(" ", spm.MARK)] * 200))
    assert len(parts) > 20  # ids come out while the text goes on


def test_round_trips(spark):
    got = {r["doc_id"]: r for r in spm.round_trips(tricky(spark)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in tricky(spark).select("doc_id", "text").collect()}
    assert all(got[i]["same"] and got[i]["text"] == texts[i] for i in texts)
    mark = spm.round_trips(frame(spark, [(1, "a\u2581b", "en")])).first()
    assert not mark["same"] and mark["text"] == "a b"
    assert spm.round_trips(empty(spark)).count() == 0


def test_a_process_holds_the_memo_that_was_asked_for():
    """Packing alone remembers more than as a stage; a worker that has served one must not serve the other by it."""
    texts = ["a few words\nand lines", "and words of a few others", ""]
    few, many = common.tokenizer(packing.TOKENIZER, 2), None
    one = [few.encode([t]) for t in texts]
    assert len(few.memo) <= 7
    many = common.tokenizer(packing.TOKENIZER, 1000)
    assert (few.memo_words, many.memo_words) == (2, 1000)
    assert [many.encode([t]) for t in texts] == one
