"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words and hashes are those of simhash.py; a text's set is its distinct shingle hashes, and texts of equal sets are one class
from the start.  What links two classes is always the similarity of their whole sets; the steps below only find the pairs:

1. SimHash fingerprints of the classes meet in the segment-popcount grid (simhash.range_join): near copies of few changes.
2. Fingerprints of two texts of similarity 0.8 differ in 10 of 64 bits on average, which no grid finds for certain.  The
   exact way for the rest is a prefix filter: two sets of similarity 0.8 share a value among the first n - ceil(0.8 n) + 1
   of each, in any order that both keep, so documents meet at the values of their prefixes.  Values that many documents of
   a sample hold come last; that decides how many pairs meet, never which link.
   At the first value that two similar sets share, at places i and j of their orders, what follows must be able to make up
   the overlap: min(n - i, m - j) >= 4 / 9 (n + m).  Pairs for which no shared value satisfies that are not formed, which
   spares those of large groups of copies that each have many changes of their own.
3. First the grid's pairs, and each document with the smallest one at each of its values, are tested and components found; then
   all pairs that meet at a value and are still in different components.  So a large group of near copies costs few tests
   for each document.
4. Of most pairs that meet, the sets are far apart.  A set's sketch has the parity of its values' number in each of some 2 n
   buckets; every value that only one of two sets holds changes one bit, so that sketches which differ in more than
   (n + m) / 9 bits rule a pair out for certain.  Only what is left is tested, and only texts that a test asks for are
   moved: a bitmap of their ids is sent to the scan, and what it lets through by chance the join drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.components import connected_components
from chartloom.llm.runtime import discard, materialize, pick, python_stage
from chartloom.llm.simhash import HOT_CELL, fingerprint_of, range_join, shingle_hashes

_SHINGLE = 5
_OVER, _UNDER = 4, 5  # a similarity of 4 / 5
_BITS = 4  # that fingerprints of the first step differ by
_SAMPLE, _OFTEN, _HOT = 8, 3, 200_000  # a document in 8; documents of it that hold a value taken last; such values at most
_SALTS = 16  # tasks over which the tests with one document are dealt
_SKETCH = 6, 15  # bits of a sketch, as powers of two: at least, at most
_ASKED = 16, 1 << 27  # bits of the bitmap of wanted ids: for each id, at most


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.column("text").cast(pa.binary()).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t or b"", _SHINGLE)).view(np.int64))], ["value"])


def _prefix(own: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The values of a sorted set that a similar set must share one of; those of `late` (sorted) come last in the order."""
    if len(late) and len(own):
        is_late = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
        own = np.concatenate((own[~is_late], own[is_late]))
    return own[: len(own) + 1 + (-_OVER * len(own)) // _UNDER] if len(own) else own


def sketch(own: np.ndarray) -> bytes:
    """The number of a set's values (8 bytes) and the parity of their number in each of a power of two of buckets."""
    buckets = 1 << min(max(_SKETCH[0], (2 * len(own)).bit_length()), _SKETCH[1])
    odd = np.bincount((own & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return len(own).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes) -> bool:
    """False only for sketches of sets that are not similar.  The larger one is folded to the buckets of the smaller."""
    if len(x) > len(y):
        x, y = y, x
    n, m = (int.from_bytes(s[:8], "little") for s in (x, y))
    few, many = (int.from_bytes(s[8:], "little") for s in (x, y))
    bits = 8 * (len(y) - 8)
    while bits > 8 * (len(x) - 8):
        bits //= 2
        many = (many >> bits) ^ (many & ((1 << bits) - 1))
    return (few ^ many).bit_count() * (_OVER + _UNDER) <= (n + m) * (_UNDER - _OVER)


def _described(late: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, prints, firsts, sketches = [], [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(t or b"", _SHINGLE)
                own = np.unique(hashes)
                names.append(divmod(xxhash.xxh3_128_intdigest(own.astype("<u8").tobytes()), 1 << 64))
                sizes.append(len(own))
                prints.append(fingerprint_of(hashes))
                firsts.append(_prefix(own, late).view(np.int64))
                sketches.append(sketch(own))
            names = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts) if firsts else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists, pa.array(sketches, pa.binary())], ["doc_id", "s0", "s1", "n", "f0", "firsts", "sketch"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, b): a null b brings a text of a, the others are tested with a's texts."""
    now, hub = None, []
    for b in batches:
        found = []
        texts = b.column("text").cast(pa.binary()).to_pylist()
        for x, salt, y, t in zip(b.column("a").to_pylist(), b.column("salt").to_pylist(), b.column("b").to_pylist(), texts, strict=True):
            if (x, salt) != now:
                now, hub = (x, salt), []
            own = np.unique(shingle_hashes(t or b"", _SHINGLE))
            if y is None:
                hub.append(own)
            elif any((_OVER + _UNDER) * len(np.intersect1d(h, own, assume_unique=True)) >= _OVER * (len(h) + len(own)) for h in hub):
                found.append((x, y))
        ends = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [any(may_be_similar(x, y) for x in xs for y in ys) for xs, ys in zip(b.column("of_a").to_pylist(), b.column("of_b").to_pylist(), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _worth_testing(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) but those that known(doc_id, sketches) rules out."""
    of_a, of_b = (known.select(F.col("doc_id").alias(f"id_{x}"), F.col("sketches").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(of_a, F.col("a") == F.col("id_a")).select("a", "b", "of_a").join(of_b, F.col("b") == F.col("id_b"))
    return both.select("a", "b", "of_a", "of_b").mapInArrow(_close, "a bigint, b bigint")


def _asked_for(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").to_numpy()
            keep = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield b.select(["doc_id", "text"]).filter(pa.array(keep.astype(bool)))

    return run


def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """texts without most of the rows whose doc_id is not in wanted(wanted), by a bitmap of hashed ids of bounded size."""
    size = min(max(64, _ASKED[0] * wanted.count()), _ASKED[1])

    def at(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(size))

    words = wanted.select(at("wanted").alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64 + 1, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return texts.withColumn("at", at("doc_id")).mapInArrow(_asked_for(bits), "doc_id bigint, text string")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.  A text of a is sent once for all the b of a salt, each text of b to its a."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int"))
    hubs = pairs.select(F.col("a").alias("wanted"), "a", "salt", F.lit(None).cast("bigint").alias("b")).distinct()
    asked = materialize(hubs.unionByName(pairs.select(F.col("b").alias("wanted"), "a", "salt", "b")), "similar-asked")
    texts = _texts_of(asked.select("wanted").distinct(), texts)
    rows = texts.join(asked, F.col("doc_id") == F.col("wanted")).select("a", "salt", "b", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    links = materialize(rows.mapInArrow(_similar, "a bigint, b bigint").distinct(), "similar-links")
    discard(asked)
    return links


def _may_overlap(n: str, i: str, m: str, j: str) -> Column:
    """Sets of n and m values that share their i-th and j-th value first, from 0, can be similar."""
    n, i, m, j = map(F.col, (n, i, m, j))
    return (F.least(n, m) * _UNDER >= F.greatest(n, m) * _OVER) & (F.least(n - i, m - j) * (_OVER + _UNDER) >= (n + m) * _OVER)


def similar_components(docs: DataFrame, hot_cell: int = HOT_CELL) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, component_id), one row per input row: the smallest doc_id reachable over links.

    Null text is empty, and texts without words are alike.  Rows that share a doc_id are one document.  Rows with a null
    doc_id get the component of their equals, or null.  An empty table gives no rows.
    """
    python_stage(docs.sparkSession)
    texts = pick(docs, doc_id="bigint", text="string")
    sampled = texts.where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLE)) == 0).mapInArrow(_values, "value bigint")
    often = sampled.groupBy("value").count().where(F.col("count") >= _OFTEN).orderBy(F.desc("count"), "value").limit(_HOT)
    late = np.sort(often.select("value").toArrow().column("value").to_numpy().view(np.uint64))  # at most _HOT values
    late.sort()
    sets = materialize(texts.mapInArrow(_described(late), "doc_id bigint, s0 bigint, s1 bigint, n bigint, f0 bigint, firsts array<bigint>, sketch binary"), "shingle-sets")
    classes = materialize(sets.groupBy("s0", "s1").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("f0").alias("f0")).where("rep is not null"), "shingle-classes")

    prints = classes.groupBy("f0").agg(F.min("rep").alias("rep"))
    alike = classes.select("f0", F.col("rep").alias("b")).join(prints, "f0").where("rep < b").select(F.col("rep").alias("a"), "b")
    near = range_join(prints, _BITS, hot_cell).unionByName(alike)

    named = classes.select(F.col("s0").alias("t0"), F.col("s1").alias("t1"), "rep")
    first_rows = sets.join(named, (F.col("doc_id") == F.col("rep")) & (F.col("s0") == F.col("t0")) & (F.col("s1") == F.col("t1")))
    first_rows = materialize(first_rows.select("rep", "n", "firsts"), "shingle-firsts")
    rows = materialize(sets.select("doc_id", "s0", "s1"), "shingle-rows")
    known = sets.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("sketch").alias("sketches"))  # a document of many rows has many
    known = materialize(known, "shingle-sketches")
    discard(sets)
    met = first_rows.select("rep", "n", F.posexplode("firsts").alias("i", "value"))
    shared = met.groupBy("value").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("value", "first")
    met = materialize(met.join(shared, "value"), "shingle-prefixes")
    discard(first_rows)
    hubs = met.where("rep = first").select("value", F.col("rep").alias("a"), F.col("n").alias("m"), F.col("i").alias("j"))
    stars = met.where("rep > first").join(hubs, "value").where(_may_overlap("n", "i", "m", "j")).select("a", F.col("rep").alias("b"))
    tested = materialize(near.unionByName(stars).where("a < b").distinct(), "similar-pairs")
    close = materialize(_worth_testing(tested, known), "similar-close")
    links = _verified(close, texts)
    labels = connected_components(links)

    placed = met.join(labels, met["rep"] == labels["node"], "left").select("value", "rep", "n", "i", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("value").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("value")
    placed = materialize(placed.join(mixed, "value"), "similar-placed")
    other = placed.select("value", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
    rest = placed.withColumnRenamed("rep", "a").join(other, "value").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & _may_overlap("n", "i", "m", "j"))
    rest = rest.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    rest = materialize(_worth_testing(rest, known), "similar-rest")
    if not rest.isEmpty():
        labels = connected_components(links.unionByName(_verified(rest, texts)))
    discard(known, met, tested, close, placed, rest)

    found = classes.join(labels, classes["rep"] == labels["node"], "left").select("s0", "s1", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "s0", "s1").join(found, ["s0", "s1"], "left").select("doc_id", "component_id")
