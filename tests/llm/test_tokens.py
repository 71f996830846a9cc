import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chartloom.llm import bpe as B
from chartloom.llm import token_rollup as R
from chartloom.llm import token_store as S
from chartloom.llm.runtime import scratch_path

from .helpers import EDGES, SF, documents

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def fuzz(n, seed=4):
    rng = random.Random(seed)
    pool = [chr(c) for c in [*range(1, 0x250), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0x301, 0x3A3, 0x130, 0xFB01, 0x4E2D, 0x1F600, 0x661, 0x2160]] + [" ", "\n", "  ", "\n\n", " the", "ing", ".", ",", "'ll", "<|endoftext|>", "<|startoftext|>", "a" * 90] * 8
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_forced_boundary_encoder_is_the_library():
    model, lib = B.bpe(WORD), library(WORD)
    for t in fuzz(3000) + [x for x in EDGES if x]:
        ids = np.frombuffer(model.encode(t.encode()), "<u4").tolist()
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert model.decode(model.encode(t.encode())).decode() == lib.decode(ids, skip_special_tokens=False)


def test_fragments_cover_words_and_words_come_back():
    model = B.bpe(WORD)
    for w in (b"a", b"thequick", b"zqxjkvb", b"caf\xc3\xa9s"):
        parts = model.fragments_of(w)
        assert b"".join(p for p, _ in parts) == w and [f for _, f in parts] == [False] * (len(parts) - 1) + [True]
    assert model.decode_words(model.encode(b"The quick brown fox")) == "the quick brown fox"


def test_heap_and_scan_merge_alike():
    model, rng = B.bpe(WORD), random.Random(1)
    for _ in range(50):
        ids = [model.plain[b] for b in rng.choices(b"abcdehinrst", k=70)]
        assert model._by_heap(list(ids)) == model._by_scan(list(ids))


def test_encode_documents(spark):
    lib = library(WORD)
    docs = documents(spark, EDGES + ["twice"] * 2, extra=True)
    for r in B.encode_documents(docs, WORD).collect():
        ids = lib.encode((EDGES + ["twice"] * 2)[r["doc_id"]] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids"], r["ids_sha256"]) == (len(ids), raw, hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert B.encode_documents(docs.limit(0), WORD).count() == 0


def test_piece_encoder_is_the_library():
    encoder, lib = S.PieceEncoder(BYTE), library(BYTE)
    texts = fuzz(4000, 9) + [x or "" for x in EDGES]
    for t, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert np.frombuffer(ids, encoder.kind).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert encoder.encode(pa.array([None], pa.string())) == [b""]


@pytest.mark.parametrize("texts", [EDGES + ["again"] * 3, []])
def test_store_round_trip(spark, texts):
    lib, folder = library(BYTE), scratch_path(spark, "test-store")
    docs = documents(spark, texts, extra=True)
    got = {r["doc_id"]: r for r in S.read_token_store(S.write_token_store(docs, BYTE, folder, length=16, docs_a_shard=4), folder).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_sequences_are_views_of_equal_length(spark):
    folder = scratch_path(spark, "test-shard")
    w = S.ShardWriter(folder, 3, "<u2", 8)
    docs = [np.arange(5, dtype="<u2"), np.arange(1200, dtype="<u2"), np.array([7], "<u2")]
    for i, d in enumerate(docs):
        w.add(i, d)
    shard, flat = S.Shard(folder, w.close()), np.concatenate(docs)
    assert len(shard) == -(-len(flat) // 8)
    back = [shard.sequence(i) for i in range(len(shard))]
    assert all(len(ids) == len(mask) == 8 for ids, mask in back)
    assert np.concatenate([ids[mask] for ids, mask in back]).tolist() == flat.tolist()
    assert not back[0][0].flags.owndata and back[-1][1].sum() == len(flat) % 8
    assert shard.span(0, len(flat)).tolist() == flat.tolist()


def test_null_ids_come_first_and_repeated_ids_are_ordered(spark):
    folder = scratch_path(spark, "test-null")
    docs = spark.createDataFrame([(5, "b b b"), (None, "a"), (5, "b")], "doc_id bigint, text string")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in S.read_token_store(S.write_token_store(docs, BYTE, folder), folder).collect())
    assert [d for _, d, _ in got] == [None, 5, 5] and got[1][2] < got[2][2]


def test_rollup_counts_signed_batches_once(spark):
    lib = library(BYTE)
    docs = documents(spark, EDGES + [None])
    counts = R.count_tokens(docs, BYTE, "v1").cache()
    assert {r["doc_id"]: r["n_tokens"] for r in counts.collect()} == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(EDGES + [None])}
    roll = R.TokenRollup(spark, scratch_path(spark, "test-rollup"))
    assert roll.totals().count() == 0
    assert roll.commit("one", R.inserts(counts)) and not roll.commit("one", R.inserts(counts))
    whole = sum(r["n_tokens"] for r in counts.collect())
    row = roll.totals().first()
    assert (row["n_docs"], row["n_tokens"]) == (len(EDGES) + 1, whole)
    from pyspark.sql import functions as F

    revised = counts.withColumn("n_tokens", F.col("n_tokens") + 1).withColumn("tokenizer", F.lit("v2"))
    roll.commit("two", R.revisions(counts, revised))
    roll.commit("three", R.deletes(revised.where("doc_id = 0")))
    roll.compact()
    assert not roll.commit("two", R.revisions(counts, revised))
    assert [(r["tokenizer"], r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()] == [("v2", len(EDGES), whole + len(EDGES))]
    roll.commit("empty", R.inserts(counts.limit(0)))
    assert roll.committed("empty")
    nulls = spark.createDataFrame([(None, None, "v1", 1, None, 3)], "source string, lang string, tokenizer string, n_docs bigint, n_chars bigint, n_tokens bigint")
    roll.commit("nulls", nulls)
    assert [(r["n_chars"], r["n_tokens"]) for r in roll.totals().where("source is null").collect()] == [(0, 3)]


def rollup_of(spark, label, **batches):
    roll = R.TokenRollup(spark, scratch_path(spark, label))
    for name, n in batches.items():
        rows = spark.createDataFrame([("s", "en", "v1", 1, n, n)] if n else [], "source string, lang string, tokenizer string, n_docs bigint, n_chars bigint, n_tokens bigint")
        assert roll.commit(name, rows.selectExpr("*", "1 AS batches", "2 AS data"))
    return roll


def test_rollup_remembers_every_id_and_survives_crashes(spark, monkeypatch):
    roll = rollup_of(spark, "test-crash", one=5, none=0, two=7)
    total = lambda: [(r["n_docs"], r["n_tokens"]) for r in R.TokenRollup(spark, roll.folder).totals().collect()]

    def crash(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(roll, "_publish", crash)
        with pytest.raises(OSError):
            roll.compact()
        with pytest.raises(OSError):
            roll.commit("three", spark.createDataFrame([("s", "en", "v1", 1, 1, 1)], R._SCHEMA))
    assert total() == [(2, 12)] and not roll.committed("three")
    assert roll.compact() and total() == [(2, 12)] and all(roll.committed(x) for x in ("one", "none", "two"))
    assert roll.compact() and total() == [(2, 12)]
    assert roll.commit("three", spark.createDataFrame([("s", "en", "v1", 1, 1, 1)], R._SCHEMA)) and total() == [(3, 13)]


def test_rollup_of_two_writers(spark, monkeypatch):
    roll = rollup_of(spark, "test-writers", one=5)
    other = R.TokenRollup(spark, roll.folder)
    row = spark.createDataFrame([("s", "en", "v1", 1, 1, 1)], R._SCHEMA)
    monkeypatch.setattr(other, "committed", lambda batch_id: False)  # both looked before either wrote
    assert not other.commit("one", row)
    write = other._write

    def meanwhile(rows):
        roll.commit("late", row)
        return write(rows)

    monkeypatch.setattr(other, "_write", meanwhile)
    assert other.compact()
    assert [(r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()] == [(2, 6)]
    fold = roll._fold()
    monkeypatch.setattr(roll, "_fold", lambda: {**fold, "number": 0})
    assert not roll._publish("folds/000000001", {"number": 1})


def test_op8_against_brute_force(spark):
    from chartloom.llm.queries import op8_token_counts

    lib, want = library(BYTE), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r["text"]:
            n, c, t = want.get((r["source"], r["lang"]), (0, 0, 0))
            want[r["source"], r["lang"]] = n + 1, c + len(r["text"]), t + 1 + len(lib.encode(r["text"], add_special_tokens=False).ids)
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_chars"], r["n_tokens"]) for r in op8_token_counts(spark, SF).collect()} == want
