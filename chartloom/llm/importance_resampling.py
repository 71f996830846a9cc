"""Importance resampling towards a target corpus by hashed word runs, counted and scored in partition-local word tries.

A trie's node stands for a run of words and holds the CRC-32 state after its UTF-8 bytes (words joined by a space), so that a
longer run is hashed from its prefix's state.  Counting: nodes hold counts; when a trie has grown to its bound, and at the end
of a partition, the counts are added to their buckets and the trie starts anew, which changes no total.  Spark sums the
buckets.  Scoring: nodes hold the gain of their bucket, and a document's weight is gathered on the trie's paths; a trie at its
bound starts anew here as well.

The table of gains, one whole number a bucket, goes to the tasks; its size is set by the parameter buckets alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.ordered import dealt, running_starts
from chartloom.llm.runtime import pick, python_stage

WORD, OTHER = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_WINDOW = 1 << 18
#: Words that a trie reads before it starts anew; it holds at most a node for each run that ends in one of them.
TRIE_WORDS = 1 << 16


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists of a quarter of a megabyte's words each, so that long texts are not held as lists."""
    text = text.lower()
    at = 0
    while at < len(text):
        end = min(len(text), at + _WINDOW)
        if end < len(text):
            cut = OTHER.search(text, end)
            end = cut.start() if cut else len(text)
        yield WORD.findall(text, at, end)
        at = end


class WordTrie:
    """Runs of 1 to longest words.

    A run that can be continued is a node [CRC state, value, children, CRC state after a space]; the longest runs are leaves,
    a value in their parent's children, hashed from the parent's state.  value_of gives a new run's value from its CRC.  A trie
    that has read over most words is given to full and starts anew.
    """

    def __init__(self, longest: int, value_of: Callable[[int], int], most: int, full: Callable[[WordTrie], None] = lambda trie: None) -> None:
        self.longest, self.value_of, self.most, self.full = longest, value_of, most, full
        self.root: list = [0, 0, {}, 0]
        self.read = 0

    def child(self, node: list, word: bytes) -> list:
        state = zlib.crc32(word, node[3])
        child = node[2][word] = [state, self.value_of(state), {}, zlib.crc32(b" ", state)]
        return child

    def _split(self, open_: list) -> tuple[list | None, list]:
        """Of the nodes that the next word continues, the one whose children are leaves, and the others."""
        return (open_[0], open_[1:]) if len(open_) == self.longest else (None, open_)

    def _restarted(self, last: list[bytes]) -> list:
        """The nodes that the next word continues, in a new trie that holds no other run; last: the words just read."""
        self.full(self)
        self.root, self.read = [0, 0, {}, 0], 0
        open_: list = [self.root]
        for word in last:
            open_ = [*(node[2].get(word) or self.child(node, word) for node in open_), self.root]
        return open_

    def count(self, text: bytes) -> None:
        """Adds one to each run of a text; value_of must give 0."""
        child, keep, last = self.child, self.longest - 1, []
        open_: list = [self.root]
        for words in words_of(text):
            root = self.root
            deep, rest = self._split(open_)
            for w in words:
                if deep:
                    leaves = deep[2]
                    leaves[w] = leaves.get(w, 0) + 1
                ended = []
                for node in rest:
                    after = node[2].get(w) or child(node, w)
                    after[1] += 1
                    ended.append(after)
                if keep:
                    ended.append(root)
                    if len(ended) > keep:
                        deep, rest = ended[0], ended[1:]
                    else:
                        rest = ended
            open_ = [deep, *rest] if deep else rest
            last = [*last, *words[-keep:]][-keep:] if keep else []
            self.read += len(words)
            if self.read > self.most:
                open_ = self._restarted(last)

    def gather(self, text: bytes) -> tuple[int, int, int]:
        """(words, runs, sum of values) of a text."""
        child, keep, last, value_of, crc32 = self.child, self.longest - 1, [], self.value_of, zlib.crc32
        open_: list = [self.root]
        n = runs = total = 0
        for words in words_of(text):
            root = self.root
            n += len(words)
            deep, rest = self._split(open_)
            for w in words:
                if deep:
                    leaves = deep[2]
                    value = leaves.get(w)
                    if value is None:
                        value = leaves[w] = value_of(crc32(w, deep[3]))
                    total += value
                    runs += 1
                ended = []
                for node in rest:
                    after = node[2].get(w) or child(node, w)
                    total += after[1]
                    ended.append(after)
                runs += len(ended)
                if keep:
                    ended.append(root)
                    if len(ended) > keep:
                        deep, rest = ended[0], ended[1:]
                    else:
                        rest = ended
            open_ = [deep, *rest] if deep else rest
            last = [*last, *words[-keep:]][-keep:] if keep else []
            self.read += len(words)
            if self.read > self.most:
                open_ = self._restarted(last)
        return n, runs, total

    def fold(self, totals: np.ndarray) -> None:
        """Adds all counts to their buckets."""
        states: list[int] = []
        counts: list[int] = []
        stack = [(self.root, self.longest)]
        while stack:
            (_, _, children, after), depth = stack.pop()
            if depth == 1:
                states += [zlib.crc32(w, after) for w in children]
                counts += children.values()
                continue
            for node in children.values():
                states.append(node[0])
                counts.append(node[1])
                stack.append((node, depth - 1))
        totals += np.bincount(np.array(states, np.int64) % len(totals), counts, len(totals)).astype(np.int64)


def bucket_counts(docs: DataFrame, longest: int = 2, buckets: int = 10_000, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(bucket, n) of all runs of 1 to longest words in docs.text, for buckets that have any.  Null texts have no words."""
    python_stage(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        trie = WordTrie(longest, lambda state: 0, trie_words, lambda full: full.fold(totals))
        for b in batches:
            for text in b.column("text").to_pylist():
                if text:
                    trie.count(text)
        trie.fold(totals)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["bucket", "n"])

    found = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(counted, "bucket int, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from the (bucket, n) of both corpora; two
    tables of at most so many rows as there are buckets come to the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((s, source), (t, target)):
        for bucket, n in table.collect():
            counts[bucket] = n
    whole_s, whole_t = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return [math.floor(1000 * math.log((int(y) + 1.0) * whole_s / ((int(x) + 1.0) * whole_t))) for x, y in zip(s, t, strict=True)]


def scored(docs: DataFrame, table: list[int], longest: int = 2, trie_words: int = TRIE_WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_features, weight), weight the floored mean of the gains of a text's runs."""
    python_stage(docs.sparkSession)
    buckets = len(table)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(longest, lambda state: table[state % buckets], trie_words)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                n, runs, total = trie.gather(text) if text else (0, 0, 0)
                rows.append((n, runs, total // runs if runs else 0))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(walked, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Draws floor(percent N / 100) of the N documents with at least least_words words, without replacement and in proportion
    to exp(weight / 1000), by the highest of weight + Gumbel noise from a document's id:

    (doc_id, n_features, weight, score, rank) of every document, rank from 1 by score (ties to the smaller doc_id, a null one
    last) and null where it is not drawn.

    docs(doc_id, text), target(text).  Null and empty texts have no features and weight 0.  The noise of rows with a null
    doc_id is that of an empty id; rows that share a doc_id are ranked each, equal ones in a row.  An empty docs gives no rows; an empty target
    leaves every t at 0.
    """
    table = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    rows = scored(pick(docs, doc_id="bigint", text="string"), table, longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("bigint")).withColumn("enough", F.col("n_words") >= least_words)
    groups = rows.groupBy("doc_id", "n_features", "weight", "score", "enough").agg(F.count("*").alias("copies"))
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranged = dealt(groups, order, "resampled")
    n = ranged.where("enough").agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    out = running_starts(ranged, order, "copies").withColumn("i", F.explode(F.expr("sequence(1L, copies)")))
    rank = F.col("start") + F.col("i")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("enough") & (rank <= percent * n // 100), rank).alias("rank"))
