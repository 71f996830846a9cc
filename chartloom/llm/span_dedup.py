"""Substring deduplication by sliding sentence spans.

Sentences.  A text is cut after runs of . ! ? and at line ends.  A stretch of words without such a place is cut as well: after
a word whose CRC-32 is lower than those of the REACH words on either side, where no other cut lies within REACH words.  Both
rules look at the words close by only, so a passage is cut alike wherever it stands and whatever it is joined to, but for
REACH words at its ends.

Spans.  Every run of `run` consecutive sentences is hashed over its lower-cased words and joined globally on 96 bits; longer
repeats are covered by the runs inside them.  The first occurrence, that of the smallest doc_id (in one text, the first),
stays; sentences covered by any later occurrence are removed.  Partial aggregation finds the first document of each repeated
span; a sort-merge join, which splits a very frequent span over tasks, brings it back to the documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.runtime import discard, materialize, pick, python_stage

RUN = 3  # sentences of a span
REACH = 4
_TOKEN = re.compile(r"[^\s.!?]+[.!?]*|[.!?]+")
_FACTOR, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _cuts(words: list[str], closed: np.ndarray) -> np.ndarray:
    """closed: the words after which a sentence ends.  The same with the cuts inside long stretches added."""
    n = len(words)
    if n < 2 * REACH + 1:
        return closed
    crc = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, n)
    inner = np.zeros(n, bool)
    middle = np.ones(n - 2 * REACH, bool)
    own = crc[REACH : n - REACH]
    for step in range(1, REACH + 1):
        middle &= own < crc[REACH - step : n - REACH - step]
        middle &= own <= crc[REACH + step : n - REACH + step]
    for step in range(-REACH, REACH):  # the word itself and its neighbours close no sentence
        middle &= ~closed[REACH + step : n - REACH + step]
    inner[REACH : n - REACH] = middle
    return closed | inner


def sentences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) offsets and the hashes of a text's sentences; each begins where the one before ended."""
    found = list(_TOKEN.finditer(text))
    n = len(found)
    if not n:
        return np.empty((0, 2), np.int64), np.empty(0, np.uint64)
    words = [m[0].lower() for m in found]
    begin, end = (np.fromiter((f(m) for m in found), np.int64, n) for f in (re.Match.start, re.Match.end))
    closed = np.fromiter((w[-1] in ".!?" for w in words), bool, n)
    lines = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
    closed[:-1] |= np.diff(np.searchsorted(lines, begin)) > 0
    closed[-1] = True
    last = np.flatnonzero(_cuts(words, closed))
    bounds = np.concatenate(([0], end[last]))
    digest, at, hashes = xxhash.xxh64_intdigest, 0, []
    for k in (last + 1).tolist():
        hashes.append(digest(" ".join(words[at:k]).encode("utf-8", "surrogatepass")))
        at = k
    return np.stack((bounds[:-1], bounds[1:]), axis=1), np.array(hashes, np.uint64)


def spans(text: str, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, start offset, end offset) of every run of `run` sentences."""
    at, hashes = sentences(text)
    n = len(at) - run + 1
    if n < 1:
        return tuple(np.empty(0, k) for k in (np.int64, np.int32, np.int32, np.int32))
    first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    other = (hashes ^ (hashes >> np.uint64(29))) * _OTHER
    for k in range(run):
        first = first * _FACTOR + hashes[k : k + n]
        second = second * _FACTOR + other[k : k + n]
        first ^= first >> np.uint64(31)
        second ^= second >> np.uint64(31)
    return (first * _OTHER).view(np.int64), ((second * _OTHER) >> np.uint64(32)).astype(np.uint32).view(np.int32), at[:n, 0].astype(np.int32), at[run - 1 :, 1].astype(np.int32)


def _span_rows(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            for doc_id, key, text in zip(b.column("doc_id").to_pylist(), b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True):
                if doc_id is None or not text:
                    continue
                h, g, s, e = spans(text, run)
                again = np.ones(len(h), bool)
                again[np.unique(np.stack((h, g.astype(np.int64)), 1), axis=0, return_index=True)[1]] = False
                for to, x in zip(parts, (np.full(len(h), doc_id, np.int64), np.full(len(h), key, np.int64), h, g, s, e, again), strict=True):
                    to.append(x)
            kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, k)) for x, k in zip(parts, kinds, strict=True)], ["doc_id", "k", "h", "g", "s", "e", "again"])

    return rows


def repeated_spans(docs: DataFrame, run: int = RUN) -> tuple[DataFrame, list[DataFrame]]:
    """docs(doc_id, text, ...) -> the spans that are not first occurrences, (doc_id, k, s, e, first) with the first's doc_id; and
    the tables to discard when these have been read.

    k is the xxhash64 of the row's text: rows are told apart by (doc_id, k), since offsets hold for one text only.  Rows that
    share a doc_id never repeat one another; each is held against smaller doc_ids.
    """
    python_stage(docs.sparkSession)
    rows = pick(docs, doc_id="bigint", text="string").withColumn("k", F.xxhash64("text"))
    rows = rows.mapInArrow(_span_rows(run), "doc_id bigint, k bigint, h bigint, g int, s int, e int, again boolean")
    rows = materialize(rows, "spans")
    inside = rows.where("again").select("doc_id", "k", "s", "e", F.col("doc_id").alias("first"))
    once = rows.where("not again")
    shared = once.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "g", "first")
    shared = materialize(shared, "spans-shared")
    later = once.join(shared, ["h", "g"]).where("doc_id > first").select("doc_id", "k", "s", "e", "first")
    return later.unionByName(inside), [rows, shared]


def _without(text: str, starts: list[int], ends: list[int]) -> tuple[str, int]:
    """text without the ranges; a removed range leaves a line end or a space where it had one around it."""
    kept, at, removed = [], 0, 0
    for s, e in sorted(zip(starts, ends, strict=True)):
        if e <= at:
            continue
        s = max(s, at)
        kept.append(text[at:s])
        removed += e - s
        at = e
    kept.append(text[at:])
    out, joined = [], ""
    for part in kept:
        if joined and part and not joined[-1].isspace() and not part[0].isspace():
            out.append(" ")
        out.append(part)
        joined = part or joined
    return "".join(out).strip(), removed


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, removed = [], []
        for text, s, e in zip(b.column("text").to_pylist(), b.column("cut_s").to_pylist(), b.column("cut_e").to_pylist(), strict=True):
            text, n = _without(text, s, e) if s and text else (text, 0)
            texts.append(text)
            removed.append(n)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), b.column("first_docs")], ["row", "text", "removed_chars", "first_docs"])


def _rows_without(docs: DataFrame, run: int) -> DataFrame:
    """(row struct of all other columns, text, removed_chars, first_docs), one row per input row."""
    found, scratch = repeated_spans(docs, run)
    cuts = found.groupBy(F.col("doc_id").alias("cut_id"), F.col("k").alias("cut_k")).agg(F.collect_set(F.struct("s", "e")).alias("cuts"), F.sort_array(F.collect_set("first")).alias("first_docs"))
    cuts = materialize(cuts.select("cut_id", "cut_k", F.col("cuts.s").alias("cut_s"), F.col("cuts.e").alias("cut_e"), "first_docs"), "span-cuts")
    discard(*scratch)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("row"), F.col("doc_id").cast("bigint").alias("key_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(cuts, (F.col("key_id") == F.col("cut_id")) & (F.xxhash64("text") == F.col("cut_k")), "left")
    rows = rows.select("row", "text", "cut_s", "cut_e", F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"))
    return rows.mapInArrow(_cut, f"row {rows.schema['row'].dataType.simpleString()}, text string, removed_chars bigint, first_docs array<bigint>")


def remove_repeated_spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs with text replaced by what is left, and columns removed_chars, first_docs (the doc_ids of the first occurrences).

    One row per input row.  All other columns stay as they are, but an input column named as one of the two is replaced.
    Rows without a repeated span keep their text to the letter (removed_chars 0, first_docs empty).  Null text stays null;
    rows with a null doc_id stay as they are; rows that share a doc_id are each cut by their own text, and never repeat one
    another.  A text may become empty; one of fewer than `run` sentences stays.  An empty table gives no rows.
    """
    made = ("removed_chars", "first_docs")
    out = _rows_without(docs, run)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in made], *made)


def drop_repeated_spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs, its own columns only: texts cut as by remove_repeated_spans, and rows gone of whose text nothing is left.

    A column n_chars is renewed where a text was cut.
    """
    out = _rows_without(docs, run).where((F.col("removed_chars") == 0) | (F.length("text") > 0))

    def own(c: str):
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("removed_chars") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`")

    return out.select(*map(own, docs.columns))
