import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from chartloom.llm import toxicity as X

from .helpers import DOCS, EDGES, documents

BAD = ["idiotic", "wretched", "scumlike"]


def corpus(n, rng):
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 120))]
        y = int(i % 5 == 0)
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ly"]))
        rows.append((i, " ".join(words), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, random.Random(1))
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    model = X.fit(docs, labels, sample=150)
    got = {r["doc_id"]: r for r in X.score_documents(docs, model).withColumn("held", X.held_out(F.col("doc_id"))).collect()}
    assert len(got) == 900 and all(r["held"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(y, got[i]["score"] >= 0.5, got[i]["rejected"]) for i, _, y in rows if got[i]["held"]]
    assert np.mean([y == p for y, p, _ in held]) > 0.97 and np.mean([y == p for y, _, p in held]) > 0.97


def test_scores_ignore_everything_but_the_text(spark):
    rows = corpus(200, random.Random(2))
    model = X.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float32), 0.2, epochs=1)
    docs = documents(spark, EDGES + ["idiotic words"], extra=False).withColumn("row", F.lit(1)).withColumn("rejected_", F.lit(2))
    a = {r["doc_id"]: r["score"] for r in X.score_documents(docs, model).collect()}
    b = {r["doc_id"] - 7: r["score"] for r in X.score_documents(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 7), model).collect()}
    assert a == b and all(0 <= s <= 1 for s in a.values()) and a[0] == a[1] == a[2]
    assert X.score_documents(docs.limit(0), model).count() == 0


def test_long_texts_are_scored_whole():
    rows = corpus(200, random.Random(3))
    model = X.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float32), 0.2)
    filler = b"abc " * (2 * X._POSITIONS)
    plain, last = X.Scorer(model).scores([filler, filler + b"idiotic scumlike wretched"])
    assert last > plain


def test_chunks_do_not_change_the_pooling(monkeypatch):
    rows = corpus(60, random.Random(4))
    model = X.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float32), 0.2, epochs=1)
    texts = [t.encode() for _, t, _ in rows]
    whole = X.Scorer(model).scores(texts)
    monkeypatch.setattr(X, "_POSITIONS", 32)
    assert np.allclose(whole, X.Scorer(model).scores(texts))


def plain_score(model, text):
    """The forward pass word by word and position by position."""
    words = X.words_of(text)
    vectors = []
    for w in words:
        flat, _ = X._hashed([w], model.buckets)
        vectors.append(model.embedding[flat].mean(axis=0))
    vectors += [np.zeros(model.size)] * (max(X.WIDTHS) - len(words))
    h = []
    for k, shift in zip(model.kernels, model.shifts):
        values = [[sum(float(vectors[at + j] @ k[j][:, f]) for j in range(len(k))) for at in range(len(vectors) - len(k) + 1)] for f in range(model.filters)]
        best = [sorted((max(v[g : g + X.GROUP]) for g in range(0, len(v), X.GROUP)), reverse=True)[: X.TOP] for v in values]
        best = [b + [-np.inf] * (X.TOP - len(b)) for b in best]
        h += [max(best[f][t] + shift[f], 0) for t in range(X.TOP) for f in range(model.filters)]
    return 1 / (1 + np.exp(-(np.dot(h, model.top) + model.intercept)))


def test_scores_are_those_of_a_plain_forward_pass():
    rows = corpus(120, random.Random(12))
    model = X.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float32), 0.2, epochs=2)
    texts = [t.encode() for _, t, _ in rows[:30]] + [b"", b"a", b"a b", b"idiotic", None, b"x" * 300 + b" wretched"]
    assert np.allclose(X.Scorer(model).scores(texts), [plain_score(model, t) for t in texts], atol=1e-4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    rows = corpus(60, random.Random(13))
    model = X.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float32), 0.2, epochs=1)
    x = rng.normal(0, 1, (25, model.size)).astype(np.float32)
    x[0] = 0
    ids = [rng.integers(1, 25, n) for n in (1, 2, 9, 40, 80)]
    labels = np.array([0, 1, 0, 1, 1], np.float32)

    def loss():
        z = np.array([float(model.logit(model.pooled(model.projected(x), i)[0][None])[0]) for i in ids])
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    dx, dk, ds, dt, di = X.gradients(model, x, ids, labels)
    checked = 0
    for value, grad in [(x, dx), *zip(model.kernels, dk), *zip(model.shifts, ds), (model.top, dt)]:
        strongest = np.argsort(-np.abs(grad).ravel())[:12]
        for at in strongest:
            place, step = np.unravel_index(at, value.shape), 2e-3
            if value is x and place[0] == 0:
                continue
            kept = value[place]
            value[place] = kept + step
            up = loss()
            value[place] = kept - step
            down = loss()
            value[place] = kept
            checked += abs((up - down) / 2 / step - grad[place]) < 2e-3 + 0.08 * abs(grad[place])
            assert abs((up - down) / 2 / step - grad[place]) < 5e-3 + 0.3 * abs(grad[place])
    assert checked > 60
    model.intercept += 1e-3
    up = loss()
    model.intercept -= 2e-3
    assert abs((up - loss()) / 2e-3 - di) < 1e-3


def test_training_lowers_the_loss_and_no_labels_give_a_constant(spark):
    rows = corpus(150, random.Random(14))
    texts, y = [t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float32)
    losses = []
    for epochs in (0, 4):
        p = np.clip(X.Scorer(X.train(texts, y, 0.2, epochs=epochs)).scores(texts), 1e-9, 1 - 1e-9)
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert losses[1] < 0.5 * losses[0]
    docs = documents(spark, EDGES)
    model = X.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert not any(r["rejected"] for r in X.score_documents(docs, model).collect())


def test_clashing_names_and_repeats(spark):
    rows = corpus(200, random.Random(15))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(1, rows[1][1], "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] * 2, "doc_id bigint, quality int, toxic int")
    odd = docs
    for c in ("score", "rejected", "row", "logit", "cut", "bin", "seen_id", "toxic"):
        odd = odd.withColumn(c, F.lit("own"))
    plain = {(r["doc_id"], r["score"]) for r in X.fit_and_score(docs, labels).collect()}
    assert {(r["doc_id"], r["score"]) for r in X.fit_and_score(odd, labels).collect()} == plain
    kept = X.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and all(r["score"] == "own" for r in kept.collect()) and 0 < kept.count() < 201


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    clean = [" ".join(sentence(10) for _ in range(20)) for _ in range(60)]
    toxic = [" ".join(sentence(10) for _ in range(6)) + " You idiotic wretched scumlike idiotic fool." for _ in range(60)]
    leak = sentence(30)
    passage = " ".join(sentence(12) for _ in range(6))
    texts = clean + toxic + [clean[0], clean[1].replace("a", "A", 1), clean[2] + " " + leak] + [f"{' '.join(sentence(10) for _ in range(30))} {passage} {sentence(9)}" for _ in range(2)]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 120)) for i in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            assert not kept & set(range(60, 120)) and kept >= set(range(60)) | {120, 121, 122, 123, 124}
        if name == "near_duplicates":
            assert kept == set(range(60)) | {123, 124} or kept == set(range(60)) | {122, 123, 124}
        if name == "repeated_passages":
            by = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert passage in by[123] and passage not in by[124] and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "benchmark_leaks":
            assert 122 not in kept and kept >= set(range(60))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_a_rare_language_with_many_labels_gets_its_threshold_from_all_of_them(spark):
    rows = corpus(1500, random.Random(6))
    docs = spark.createDataFrame([(i, t, "xx" if i % 15 == 0 or i % 15 == 1 else "en", "s", len(t)) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    model = X.fit(docs, labels, sample=40)  # 40 rows a label hold about three of label 1 in xx, of about 80 to calibrate with
    assert set(model.thresholds) == {"en", "xx"}


def test_scoring_once_is_fitting_and_scoring(spark):
    rows = corpus(400, random.Random(7))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: (round(r["score"], 6), r["rejected"]) for r in X.fit_and_score(docs, labels).collect()}
    assert got == {r["doc_id"]: (round(r["score"], 6), r["rejected"]) for r in X.score_documents(docs, X.fit(docs, labels)).collect()}


def test_long_words_are_read_whole():
    word = b"x" * 100
    assert X.words_of(word + b"idiotic") != X.words_of(word + b"harmless")
    pieces = X.words_of(word + b"idiotic" + b"y" * 100)
    assert max(map(len, pieces)) <= X.PIECE and any(b"idioti" in p for p in pieces)
    rows = corpus(200, random.Random(9))
    model = X.train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float32), 0.2, epochs=1)
    plain, other = X.Scorer(model).scores([word + b"abcabc" * 5, word + b"idioticscumlikewretched"])
    assert plain != other


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(60, random.Random(16))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(None, None, None, None, None), (None, rows[1][1], "en", "s", 1), (200, "", "en", None, 0), (201, None, "en", "s", None), (1, rows[1][1], "en", "s", 1)], DOCS)
    for c in ("score", "rejected", "row", "removed_chars", "first_docs", "k", "gone_id", "value", "rep", "component_id", "ids"):
        docs = docs.withColumn(c, F.lit("own"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (None, "x")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = out.select("doc_id", "score", "removed_chars").collect()
        assert len(kept) and all(r["score"] == r["removed_chars"] == "own" for r in kept), name
        assert sum(r["doc_id"] is None for r in kept) >= 1, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() == docs.count() and last(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_a_null_language_has_the_threshold_of_the_empty_one(spark):
    from pyspark.sql import functions as F

    model = X.ToxicityModel.__new__(X.ToxicityModel)
    model.thresholds = {"": 0.9, "en": 0.2}
    rows = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "en", -1.0), (4, "de", 1.0), (5, None, 3.0)], "i int, lang string, logit double")
    got = X._decided(rows.select(F.struct("i").alias("row"), "lang", "logit"), model).select("row.i", "rejected").collect()
    assert dict(map(tuple, got)) == {1: False, 2: False, 3: True, 4: True, 5: True}
