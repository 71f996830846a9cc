"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

Words are runs of anything but ASCII white space, lower-cased; a run of over PIECE bytes is taken as successive pieces that
overlap by the longest part but one byte, so that every part of it counts and no piece drowns in the rest.  A word's embedding is the mean of the embeddings of its
hashed parts: the word itself between brackets, and that string's runs of 3 to 6 bytes, so that words never seen share what
their parts have taught.  Filters of several widths slide over the words of the whole text; of each filter's local maxima
(over 8 positions) the three highest pass a rectifier, so that words which mean little once and much when they recur can be
told, and a logistic unit gives the score.  Training is by Adagrad from embeddings whose first
component starts at the parts' log odds in the sample; only the positions where a filter had its maximum pass a gradient back.

Fitting uses a bounded sample of labelled rows (`sample` of each label, chosen by a hash of doc_id) outside the held-out
fifth and a part kept for calibration; class counts over all labelled rows correct the intercept for the sample's balance.
All labelled rows that were neither held out nor trained on are scored on the executors, and histograms of their scores by
language and label move the intercept so that 0.5 is the cut of the highest F1.  The score sees the text alone.  Decisions
may differ by language: for each language with 10 or more such rows of label 1 the cut of its highest F0.5 is kept, which
weighs clean documents lost twice as much as toxic ones left, and 0.5 elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.runtime import materialize, pick, python_stage

WIDTHS = (1, 2, 3)
RUNS = (3, 4, 5, 6)  # bytes of a word's parts
PIECE = 64  # bytes of a word at most
_WORDS_KEPT = 100_000
_POSITIONS = 1 << 15  # positions of a text scored at once, a multiple of GROUP
_BINS = 64  # histogram bins for one unit of a logit
GROUP, TOP = 8, 3  # positions of a local maximum, and how many of the highest count


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows whose labels are never learned from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    common = max(RUNS) - 1
    return [w[at : at + PIECE] for w in words for at in range(0, max(1, len(w) - common), PIECE - common)]


def _hashed(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the words' parts, word after word, and where each word's begin: the whole, then its runs by size."""
    flats, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for at in range(0, len(words), 4096):
        own = [b"<" + w + b">" for w in words[at : at + 4096]]
        length = np.fromiter(map(len, own), np.int64, len(own))
        raw = np.frombuffer(b"".join(own) + bytes(max(RUNS)), np.uint8).astype(np.uint64)
        n, ends = int(length.sum()), np.cumsum(length)
        word = np.repeat(np.arange(len(own)), length)
        offset = np.arange(n) - (ends - length)[word]
        runs = np.stack([np.maximum(length - k + 1, 0) for k in RUNS])
        size = 1 + runs.sum(axis=0)
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        flat[start] = np.fromiter((zlib.crc32(w) for w in own), np.int64, len(own)) & (buckets - 1)
        packed, filled, before = np.zeros(n, np.uint64), 0, start + 1
        for k, count in zip(RUNS, runs, strict=True):
            for j in range(filled, k):
                packed |= raw[j : j + n] << np.uint64(8 * j)
            filled = k
            here = offset < count[word]
            h = (packed[here] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            flat[before[word[here]] + offset[here]] = (h >> np.uint64(40)).astype(np.int64) & (buckets - 1)
            before = before + count
        flats.append(flat)
        sizes.append(size)
    sizes = np.concatenate(sizes)
    return np.concatenate(flats), np.cumsum(sizes) - sizes


@dataclass
class ToxicityModel:
    buckets: int = 1 << 17
    size: int = 12
    filters: int = 8
    embedding: np.ndarray = field(default=None, repr=False)
    kernels: list[np.ndarray] = field(default_factory=list, repr=False)  # by width: (width, size, filters)
    shifts: list[np.ndarray] = field(default_factory=list, repr=False)
    top: np.ndarray = field(default=None, repr=False)
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, self.size), np.float32)
        flat, starts = _hashed(words, self.buckets)
        sizes = np.diff(np.append(starts, len(flat)))
        return np.add.reduceat(self.embedding[flat], starts, axis=0) / sizes[:, None].astype(np.float32)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """A word's share in every filter at every place of its window, widths one after another."""
        return np.concatenate([vectors @ k[j] for k in self.kernels for j in range(len(k))], axis=1)

    def pooled(self, shares: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The TOP highest local maxima of all filters over a text of word numbers (0: padding), and where they lie.

        Both (widths, TOP, filters).  A local maximum is that of GROUP positions; a text with fewer groups has -inf.
        """
        longest, f = max(len(k) for k in self.kernels), self.filters
        if len(ids) < longest:
            ids = np.concatenate((ids, np.zeros(longest - len(ids), ids.dtype)))
        best = np.full((len(self.kernels), TOP, f), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64)
        last = len(ids) - longest
        for at in range(0, last + 1, _POSITIONS):
            rows, column = shares[ids[at : at + _POSITIONS + longest - 1]], 0
            for w, k in enumerate(self.kernels):
                n = len(rows) - len(k) + 1 if at + _POSITIONS > last else _POSITIONS
                z = rows[:n, column : column + f]
                for j in range(1, len(k)):
                    z = z + rows[j : j + n, column + j * f : column + (j + 1) * f]
                column += len(k) * f
                groups = -(-n // GROUP)
                padded = np.full((groups * GROUP, f), -np.inf, np.float32)
                padded[:n] = z
                padded = padded.reshape(groups, GROUP, f)
                local = padded.max(axis=1)
                own = np.argpartition(local, groups - TOP, axis=0)[groups - TOP :] if groups > TOP else np.repeat(np.arange(groups)[:, None], f, axis=1)
                value = np.concatenate((best[w], np.take_along_axis(local, own, axis=0)))
                inside = padded[own, :, np.arange(f)[None, :]].argmax(axis=2)
                place = np.concatenate((where[w], at + own * GROUP + inside))
                order = np.argsort(-value, axis=0, kind="stable")[:TOP]
                best[w], where[w] = np.take_along_axis(value, order, axis=0), np.take_along_axis(place, order, axis=0)
        return best, where

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        """Of pooled maxima (texts, widths, TOP, filters)."""
        return self.hidden(pooled) @ self.top + self.intercept

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + np.array(self.shifts)[None, :, None, :], 0).reshape(len(pooled), -1)


class Scorer:
    """A model with the words it has met, within a bound."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        width = sum(len(k) for k in self.model.kernels) * self.model.filters
        self.shares = np.zeros((1, width), np.float32)
        self.used = 1

    def _meet(self, words: list[bytes]) -> None:
        rows = self.model.projected(self.model.vectors(words))
        if self.used + len(rows) > len(self.shares):
            grown = np.zeros((max(2 * len(self.shares), self.used + len(rows)), self.shares.shape[1]), np.float32)
            grown[: self.used] = self.shares[: self.used]
            self.shares = grown
        self.shares[self.used : self.used + len(rows)] = rows
        self.known.update(zip(words, range(self.used, self.used + len(rows)), strict=True))
        self.used += len(rows)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts)))

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        pooled = []
        for text in texts:
            words = words_of(text)
            new = set(words).difference(self.known)
            if self.used + len(new) > _WORDS_KEPT and self.used > 1:
                self._forget()
                new = set(words)
            new = sorted(new)
            for at in range(0, len(new), 4096):
                self._meet(new[at : at + 4096])
            pooled.append(self.model.pooled(self.shares, np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))[0])
        z = self.model.logit(np.array(pooled, np.float32)) if pooled else np.zeros(0)
        return np.clip(z.astype(np.float64), -35, 35)


def gradients(model: ToxicityModel, x: np.ndarray, ids: list[np.ndarray], labels: np.ndarray):
    """Of the mean cross entropy of texts, given as rows of the word vectors x (row 0: padding): by x, kernels, shifts, top, intercept.

    Only the positions where a filter had one of its maxima pass a gradient back.
    """
    f, dx, dk = model.filters, np.zeros_like(x), [np.zeros_like(k) for k in model.kernels]
    shares = model.projected(x)
    got = [model.pooled(shares, i) for i in ids]
    h, where = model.hidden(np.array([g[0] for g in got])), [g[1] for g in got]
    p = 1 / (1 + np.exp(-np.clip(h @ model.top + model.intercept, -30, 30)))
    error = ((p - labels) / len(ids)).astype(np.float32)
    dh = error[:, None] * model.top[None, :] * (h > 0)
    for r, own in enumerate(ids):
        i = own if len(own) >= max(WIDTHS) else np.concatenate((own, np.zeros(max(WIDTHS), own.dtype)))
        for w, k in enumerate(model.kernels):
            for g, at_word in zip(dh[r].reshape(len(WIDTHS), TOP, f)[w], where[r][w], strict=True):
                for j in range(len(k) if g.any() else 0):
                    u = i[at_word + j]
                    dk[w][j] += (x[u] * g[:, None]).T
                    np.add.at(dx, u, (k[j] * g[None, :]).T)
    ds = [dh.reshape(-1, len(WIDTHS), TOP, f)[:, w].sum((0, 1)) for w in range(len(WIDTHS))]
    return dx, dk, ds, h.T @ error, float(error.sum())


def train(texts: list[bytes], labels: np.ndarray, positive_rate: float, epochs: int = 8, batch: int = 32, rate: float = 0.3, seed: int = 7) -> ToxicityModel:
    """Fit on a sample; positive_rate is the share of label 1 among all rows that the sample stands for."""
    model, rng = ToxicityModel(), np.random.default_rng(seed)
    f, d = model.filters, model.size
    vocabulary: dict[bytes, int] = {b"": 0}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    flat, starts = _hashed(list(vocabulary), model.buckets)
    ends = np.append(starts[1:], len(flat))
    count = np.zeros((2, model.buckets))
    for x, y in zip(ids, labels.tolist(), strict=True):
        own = np.unique(x)
        count[int(y), np.unique(np.concatenate([flat[starts[w] : ends[w]] for w in own.tolist()]) if len(own) else np.empty(0, np.int32))] += 1
    n1 = max(1, int(labels.sum()))
    n0 = max(1, len(labels) - n1)
    odds = np.log((count[1] + 1) / (n1 + 2)) - np.log((count[0] + 1) / (n0 + 2))
    odds[count.sum(0) < 3] = 0
    model.embedding = rng.normal(0, 0.1, (model.buckets, d)).astype(np.float32)
    model.embedding[:, 0] = odds
    model.kernels = [rng.normal(0, 0.3 / np.sqrt(w), (w, d, f)).astype(np.float32) for w in WIDTHS]
    for k in model.kernels:
        k[:, 0, : f // 2] += 1 / len(k)
    model.shifts = [np.full(f, -0.3, np.float32) for _ in WIDTHS]
    model.top = np.repeat(np.tile(np.array([0.3, 0.2, 0.2], np.float32)[:TOP], len(WIDTHS)), f)
    model.intercept = -1.0
    sums = {"e": np.full(model.buckets, 1e-2, np.float32), "k": [np.full_like(k, 1e-2) for k in model.kernels], "s": [np.full_like(s, 1e-2) for s in model.shifts], "t": np.full_like(model.top, 1e-2), "i": 1e-2}
    for _ in range(epochs if len(ids) else 0):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            own, inverse = np.unique(np.concatenate([np.zeros(1, np.int32), *[ids[r] for r in rows]]), return_inverse=True)
            local = np.split(inverse[1:], np.cumsum([len(ids[r]) for r in rows])[:-1])
            sizes = (ends - starts)[own]
            at_parts = np.repeat(starts[own] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            buckets = flat[at_parts]
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            x = np.add.reduceat(model.embedding[buckets], begin, axis=0) / sizes[:, None].astype(np.float32)
            x[0] = 0  # padding
            dx, dk, ds, dt, di = gradients(model, x, local, labels[rows])
            for w in range(len(WIDTHS)):
                for value, grad, total in ((model.kernels[w], dk[w], sums["k"][w]), (model.shifts[w], ds[w], sums["s"][w])):
                    total += grad**2
                    value -= rate * grad / np.sqrt(total)
            sums["t"] += dt**2
            model.top -= rate * dt / np.sqrt(sums["t"])
            sums["i"] += di**2
            model.intercept -= rate * di / np.sqrt(sums["i"])
            dx[0] = 0
            touched = np.flatnonzero(np.abs(dx).sum(axis=1))
            if len(touched):
                pick_parts = np.concatenate([np.arange(begin[t], begin[t] + sizes[t]) for t in touched])
                grad = np.repeat(dx[touched] / sizes[touched][:, None], sizes[touched], axis=0)
                which, back = np.unique(buckets[pick_parts], return_inverse=True)
                summed = np.zeros((len(which), d), np.float32)
                np.add.at(summed, back, grad)
                sums["e"][which] += (summed**2).mean(axis=1)
                model.embedding[which] -= rate * summed / np.sqrt(sums["e"][which])[:, None]
    share = n1 / (n0 + n1)
    rate1 = min(max(positive_rate, 1e-6), 1 - 1e-6)
    model.intercept += float(np.log(rate1 / (1 - rate1)) - np.log(share / (1 - share)))
    return model


def _best_cut(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, beta: float = 1.0) -> float:
    """The logit of the highest F-beta, midway between the lowest bin above it and the next that has rows."""
    z, at = np.unique(-bins, return_inverse=True)
    hit = np.cumsum(np.bincount(at, weights * labels, len(z)))
    k = int(np.argmax((1 + beta**2) * hit / (np.cumsum(np.bincount(at, weights, len(z))) + beta**2 * max(float(hit[-1]), 1e-9))))
    return float((1 - z[k] - (z[k + 1] if k + 1 < len(z) else z[k] + _BINS)) / 2 / _BINS)


def _labelled(labels: DataFrame) -> DataFrame:
    """The distinct labelled rows that may be learned from."""
    return pick(labels, doc_id="bigint", toxic="int").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()


def calibrate(model: ToxicityModel, scored: DataFrame, labels: DataFrame, trained_on: list[int]) -> None:
    """Shift the intercept so that 0.5 is the best cut over all labelled rows not trained on; then set each language's threshold.

    scored(doc_id, lang, logit) holds the model's logits.  The rows count by their label's share of all labelled rows, and
    by that within the language for the language's threshold.  Only histograms reach the driver, for the languages that get a
    threshold.
    """
    spark = scored.sparkSession
    seen = F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(trained_on))], "seen_id bigint"))
    rows = scored.join(_labelled(labels), "doc_id").join(seen, F.col("doc_id") == F.col("seen_id"), "left")
    rows = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", F.col("seen_id").isNull().alias("unseen"), F.floor(F.col("logit") * _BINS).cast("int").alias("bin"))
    rows = materialize(rows.groupBy("lang", "toxic", "unseen", "bin").agg(F.count("*").alias("n")), "toxicity-histograms")

    def read(table: DataFrame) -> list[np.ndarray]:
        got = table.toArrow()
        return [np.array(got.column(c).to_pylist(), object if c == "lang" else float) for c in ("toxic", "unseen", "bin", "n", *(["lang"] if "lang" in got.column_names else []))]

    def cut_of(y: np.ndarray, unseen: np.ndarray, bins: np.ndarray, n: np.ndarray, beta: float) -> float | None:
        of = [[float(n[(y == v) & (unseen >= u)].sum()) for u in (0, 1)] for v in (0, 1)]
        if of[1][1] < 10 or not of[0][1]:
            return None
        own = unseen == 1
        return _best_cut(bins[own], y[own], (n * np.where(y == 1, of[1][0] / of[1][1], of[0][0] / of[0][1]))[own], beta)

    cut = cut_of(*read(rows.groupBy("toxic", "unseen", "bin").agg(F.sum("n").alias("n"))), 1.0)
    if cut is None:
        return
    shift = min(max(cut, -4.0), 4.0)
    model.intercept -= shift
    enough = rows.where("unseen and toxic = 1").groupBy("lang").agg(F.sum("n").alias("ones")).where("ones >= 10").select("lang")
    y, unseen, bins, n, langs = read(rows.join(enough, "lang"))
    for code in sorted(set(langs)):
        own = langs == code
        cut = cut_of(y[own], unseen[own], bins[own], n[own], 0.5)
        if cut is not None:
            model.thresholds[code] = float(1 / (1 + np.exp(-min(max(cut - shift, -3.0), 3.0))))


def _trained(docs: DataFrame, labels: DataFrame, sample: int, calibration_share: int) -> tuple[ToxicityModel, list[int]]:
    """A model before calibration, and the doc_ids it was trained on.  A small sample is gone over more often."""
    known = _labelled(labels)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    kept = F.crc32(F.concat(F.lit("calibration "), F.col("doc_id").cast("string"))) % calibration_share == 0
    draw = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).where(~kept).orderBy(draw, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = pick(docs, doc_id="bigint", text="string").where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow()  # a text an id
    ids = rows.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    text = rows.column("text").cast(pa.binary()).take(pa.array(order)).to_pylist()
    y = rows.column("toxic").to_numpy()[order].astype(np.float32)
    del rows
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    model = train(text, y, n1 / max(1, n1 + n0), epochs=min(40, max(8, 20_000 // max(1, len(y)))))
    return model, ids.tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2500, calibration_share: int = 4) -> ToxicityModel:
    """Train on docs(doc_id, text, lang) joined with labels(doc_id, toxic), held-out rows aside, and calibrate.

    `sample` bounds the rows of each label that are trained on (2 * sample texts reach the driver).  A labelled row in
    `calibration_share` is never trained on; these and all others outside the sample set the cut and the thresholds by
    language, whatever the table's size.  Null labels, ids and texts are left out of the sample; repeated label rows count
    once, and of the texts of one doc_id the sample holds the least.  Without any labelled row the model is constant.
    """
    model, ids = _trained(docs, labels, sample, calibration_share)
    own = pick(docs, doc_id="bigint", text="string", lang="string").join(_labelled(labels).select("doc_id").distinct(), "doc_id", "left_semi")
    calibrate(model, _with_logits(own, model, ["doc_id"]).select("doc_id", "lang", "logit"), labels, ids)
    return model


def fit_and_score(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """score_documents(docs, fit(docs, labels)), or the named columns of it with score and rejected; each text is scored once."""
    return _flat(_fitted_rows(docs, labels, columns or docs.columns))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, its own columns only, without the rows that a model fitted on labels rejects by the threshold of their language.

    Null and empty texts are scored as texts without words; repeated rows are scored alike; empty tables give no rows.
    """
    return _fitted_rows(docs, labels, docs.columns).where(~F.col("rejected")).select("row.*")


def _fitted_rows(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    model, ids = _trained(docs, labels, 2500, 4)
    before = model.intercept
    scored = materialize(_with_logits(docs, model, columns), "toxicity-logits")
    calibrate(model, scored.select("doc_id", "lang", "logit"), labels, ids)
    return _decided(scored.withColumn("logit", F.col("logit") + F.lit(float(model.intercept - before))), model)


def _with_logits(docs: DataFrame, model: ToxicityModel, columns: list[str]) -> DataFrame:
    """(row struct of the named columns, doc_id, lang, logit double); lang is null where the table has none."""
    spark = docs.sparkSession
    python_stage(spark)
    shared = spark.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    within = "text" in columns  # then the text travels once, inside the row
    text = [] if within else [F.col("text").cast("string").alias("text")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), *text)
    row = held.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            own = pc.struct_field(b.column("row"), "text") if within else b.column("text")
            logits = pa.array(scorer.logits(own.cast(pa.string()).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("lang"), logits], ["row", "doc_id", "lang", "logit"])

    return held.mapInArrow(run, f"row {row}, doc_id bigint, lang string, logit double")


def _decided(scored: DataFrame, model: ToxicityModel) -> DataFrame:
    """(row, score, rejected) of rows with logits."""
    cut = F.lit(0.5)
    for code, value in model.thresholds.items():
        cut = F.when(F.coalesce("lang", F.lit("")) == code, F.lit(value)).otherwise(cut)  # calibrate() counts null as ''
    return scored.select("row", (1 / (1 + F.exp(-F.col("logit")))).alias("score"), cut.alias("cut")).select("row", "score", (F.col("score") >= F.col("cut")).alias("rejected"))


def _flat(decided: DataFrame) -> DataFrame:
    own = [c for c in decided.schema["row"].dataType.names if c not in ("score", "rejected")]
    return decided.select(*[F.col(f"row.`{c}`") for c in own], "score", "rejected")


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with columns score (double), and rejected (boolean, by the threshold of the row's language).

    Whole texts are scored; null or empty text has the score of a text without words.  lang, where the table has it, only
    picks the threshold.  All other columns and rows stay as they are, repeated rows included, but an input column named
    score or rejected is replaced.  An empty table gives no rows.
    """
    return _flat(_decided(_with_logits(docs, model, docs.columns), model))
