import random

import numpy as np
import pytest

from chartloom.llm import simhash as S
from chartloom.llm.components import connected_components

from .helpers import EDGES, SF, components, documents, fingerprint


def check(spark, texts, **kw):
    got = {r["doc_id"]: r for r in S.near_duplicates(documents(spark, texts, **kw)).collect()}
    fps = {i: fingerprint(t, 4) for i, t in enumerate(texts)}
    assert {i: got[i]["f0"] % (1 << 64) for i in fps} == fps
    assert {i: got[i]["component_id"] for i in fps} == components(list(fps), fps, 4)


def test_edge_texts_and_clashing_columns(spark):
    check(spark, EDGES + EDGES[:3] + ["A a A"], extra=True)


def test_whole_table(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]
    check(spark, texts)


def test_empty_table_null_and_repeated_ids(spark):
    docs = documents(spark, ["same text here now", "same text here now"])
    assert S.near_duplicates(docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") == 0, None).otherwise(7)).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(7)))
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in S.near_duplicates(odd).collect()) == [(False, 7), (False, 7), (True, 7)]
    alone = docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("bigint"))
    assert [r["component_id"] for r in S.near_duplicates(alone).collect()] == [None]
    assert S.drop_near_duplicates(odd).count() == 3


def counts_of(x):
    return [(x >> 2 * i & 1) + (x >> 2 * i + 1 & 1) for i in range(32)]


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_thermometer_words_hold_the_segment_counts():
    rng = random.Random(5)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = flipped(rng, x, rng.randint(0, 20)) if rng.random() < 0.5 else rng.getrandbits(64)
        l1 = sum(abs(p - q) for p, q in zip(counts_of(x), counts_of(y)))
        words = S.thermometer(np.array([x, y], np.uint64))
        assert S.manhattan(words[:1], words[1:])[0] == l1 <= (x ^ y).bit_count()


def test_cells_meet_within_the_guaranteed_distance():
    rng = random.Random(3)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = flipped(rng, x, rng.randint(0, 5))
        cells, rows = S.grid_cells(S.thermometer(np.array([x, y], np.uint64)))
        assert set(cells[rows == 0].tolist()) & set(cells[rows == 1].tolist())
    with pytest.raises(ValueError):
        S.SimHashParams(distance=6)


def test_pairs_beyond_the_manhattan_distance_are_not_compared(monkeypatch):
    fp = np.array([0, 0b1111, 0b0101], np.uint64)
    words = S.thermometer(fp)
    assert S._near(fp, words, np.array([0, 0, 1]), np.array([1, 2, 2]), 2).tolist() == [False, True, True]
    monkeypatch.setattr(S, "manhattan", lambda x, y: np.full(len(x), 99))
    assert not S._near(fp, words, np.array([0]), np.array([2]), 2).any()


def test_cells_are_the_same_in_spark_and_numpy_and_hot_ones_lose_no_link(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({flipped(rng, b, rng.randint(0, 6)) for b in base for _ in range(150)})
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    classes = spark.createDataFrame(rows, "rep bigint, f0 bigint")
    want = components(list(range(len(fps))), fps, 4)
    for hot in (S.HOT_CELL, 20):
        got = {r["node"]: r["component"] for r in connected_components(S.range_join(classes, 4, hot)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_large_cells_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
    fp = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 3, replace=False))) for b in base for _ in range(120)], np.uint64)
    cell = np.zeros(len(fp), np.int64)
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in S._linked(cell, fp, 4):
        parent[root(i)] = root(j)
    want = components(list(range(len(fp))), [int(x) for x in fp], 4)
    assert len({root(i) for i in range(len(fp))}) == len(set(want.values()))


def test_similarity_stage_drops_near_copies_and_keeps_the_rest(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(400))
    base = [text() for _ in range(20)]
    copies = []
    for t in base[:10]:
        w = t.split()
        w[rng.randrange(400)] = "changed"
        copies.append(" ".join(w))
    kept = sorted(r["doc_id"] for r in S.drop_near_duplicates(documents(spark, base + copies + base[:2])).collect())
    assert kept == list(range(20))


def test_components_of_chain_star_and_empty(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (61, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(62)}, **{1000 + i: 1000 for i in range(40)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similarity_stage_is_exact_at_its_cut(spark):
    from chartloom.llm.similar_texts import similar_components

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = ["", None, "one two", "One  two"]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(20, 90))]
        texts.append(" ".join(base))
        for _ in range(3):  # similarities on both sides of 0.8, some of them links of a chain
            own = base + [word() for _ in range(rng.randrange(0, 30))] if rng.random() < 0.5 else [w if rng.random() > 0.03 else word() for w in base]
            texts.append(" ".join(own))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in similar_components(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == label
    kept = {r["doc_id"] for r in S.drop_near_duplicates(documents(spark, texts)).collect()}
    assert kept == set(label)


def test_sketches_rule_out_no_similar_pair_and_fold_to_the_smaller_one():
    from chartloom.llm.similar_texts import may_be_similar, sketch

    rng = np.random.default_rng(3)
    ruled_out = 0
    for n in (0, 1, 5, 30, 33, 64, 500, 16_000, 30_000):
        own = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        assert may_be_similar(sketch(own), sketch(own))
        for share in (0.5, 0.7, 0.79, 0.8, 0.81, 0.9):
            kept = own[: int(np.ceil(len(own) * share))]
            for more in (0, len(own) // 20, len(own) // 3):
                other = np.unique(np.concatenate((kept, rng.integers(0, 1 << 64, more, np.uint64, endpoint=False))))
                both = len(np.intersect1d(own, other))
                similar = 5 * both >= 4 * (len(own) + len(other) - both)
                answers = {may_be_similar(sketch(own), sketch(other)), may_be_similar(sketch(other), sketch(own))}
                assert len(answers) == 1 and (True in answers or not similar)
                ruled_out += not similar and False in answers
    assert ruled_out > 60


def test_texts_that_share_rare_values_only_are_not_moved(spark, monkeypatch):
    from chartloom.llm import similar_texts

    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 7))
    passage = [word() for _ in range(40)]
    texts = [" ".join(passage + [word() for _ in range(60)]) for _ in range(30)]  # 36 of 160 shingles in common: far apart
    texts += [t + " end" for t in texts[:3]]
    asked, scanned = [], []
    materialize, texts_of = similar_texts.materialize, similar_texts._texts_of

    def counted(df, label):
        out = materialize(df, label)
        asked.extend([out.count()] if label == "similar-asked" else [])
        return out

    def seen(wanted, rows):
        out = texts_of(wanted, rows)
        scanned.append((wanted.count(), {r[0] for r in wanted.collect()} <= {r[0] for r in out.select("doc_id").collect()}, out.count()))
        return out

    monkeypatch.setattr(similar_texts, "materialize", counted)
    monkeypatch.setattr(similar_texts, "_texts_of", seen)
    got = {r["doc_id"]: r["component_id"] for r in similar_texts.similar_components(documents(spark, texts)).collect()}
    assert sorted(k for k, c in got.items() if k != c) == sorted(got)[-3:]
    assert sum(asked) == 6  # three pairs, both ends
    assert all(whole and found <= n + 10 for n, whole, found in scanned)
