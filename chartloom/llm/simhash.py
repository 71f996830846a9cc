"""SimHash near-duplicate detection with a segment-popcount index.

Fingerprints.  Words are runs of anything but ASCII white space, A-Z lower-cased; every k-word shingle (repeats included)
is hashed with XXH64, seed 42, over its UTF-8 bytes; bit i is set when it is set in more than half of the hashes.  A text
of fewer than k words is one shingle; a text without words has fingerprint zero.

Embedding.  A fingerprint is cut into segments of two bits and mapped to the vector of their popcounts, 32 numbers from 0
to 2.  A flipped bit moves one count by one, so the Manhattan distance of two vectors is at most the Hamming distance of
the fingerprints.  The vector is held as a thermometer word: each segment's bits pushed to its low end.  Two thermometer
words differ in as many bits as the vectors' Manhattan distance, which so costs one XOR and one popcount.  (Wider segments
make coarser grids: of 8 bits, a cell would hold some thousandth of the corpus; of two, a group's grid has 3^16 cells.)

Range join.  When two vectors lie within distance d, one half of the segments lies within d // 2 <= 2, and then there is a
grid point at most one step from each.  So every fingerprint enters, for each half, its own cell of the grid and those one
step away in one count; any two within Manhattan distance 5 meet in a cell.  In a cell, first the Manhattan distance of the
whole vectors rules pairs out, then the Hamming distance decides.

Scale.  Identical fingerprints are collapsed before the join, and a cell gives only the edges of a spanning forest of its
links, never all pairs.  Cells are counted before (a sum over the distinct cells); one of more than HOT_CELL rows is dealt
into blocks, and every two of its blocks meet in a task of their own, so that no cell is held by one task.  Components are
found by hooking (components.py).  Rows that share a doc_id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.components import connected_components
from chartloom.llm.runtime import materialize, pick, python_stage

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEED = 42
_HASH_BLOCK = 1 << 16  # shingles whose bits are counted at once
_SMALL_CELL = 64
HOT_CELL = 30_000  # rows of a cell from which on it is dealt into blocks
_HALF = 32  # bits of a half of the fingerprint, 16 segments
_LOW = np.uint64(0x5555555555555555)  # the low bit of every segment


@dataclass(frozen=True)
class SimHashParams:
    """shingle: words of a shingle.  distance: bits two linked fingerprints may differ by, at most 5, which the grid finds
    for certain."""

    shingle: int = 4
    distance: int = 4

    def __post_init__(self):
        if not 0 <= self.distance <= 5:
            raise ValueError("the grid is exact up to 5 bits")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of one UTF-8 text, repeats included; empty for a text without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], _SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, as an unsigned 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASH_BLOCK):
        h = hashes[at : at + _HASH_BLOCK].astype("<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one UTF-8 text; null is given as b''."""
    return fingerprint_of(shingle_hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "f0"])

    return run


def thermometer(fp: np.ndarray) -> np.ndarray:
    """The segment popcounts of unsigned 64-bit fingerprints: each two-bit segment's count k as its k low bits."""
    high, low = (fp >> np.uint64(1)) & _LOW, fp & _LOW
    return (high | low) | ((high & low) << np.uint64(1))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of the count vectors of two arrays of thermometer words."""
    return np.bitwise_count(x ^ y).astype(np.int64)


def grid_cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of n thermometer words: the cells each enters, and the row of each.  By half: its own, and those one count away.

    A cell is a half's counts, with the number of the half in bit 32.
    """
    cells, rows, every = [], [], np.arange(len(counts))
    for half in (0, 1):
        own = (counts >> np.uint64(_HALF * half)) & np.uint64(0xFFFFFFFF)
        name = np.uint64(half << 32)
        cells.append(own | name)
        rows.append(every)
        for segment in range(_HALF // 2):
            one, two = np.uint64(1 << 2 * segment), np.uint64(2 << 2 * segment)
            empty, full = (own & one) == 0, (own & two) != 0
            cells.append((own ^ np.where(full, two, one)) | name)  # 2 -> 1, 1 -> 0, 0 -> 1
            rows.append(every)
            middle = np.flatnonzero(~empty & ~full)
            cells.append((own[middle] | two) | name)  # 1 -> 2
            rows.append(middle)
    return np.concatenate(cells), np.concatenate(rows)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, rep = (b.column(n).to_numpy(zero_copy_only=False) for n in ("f0", "rep"))
        for at in range(0, len(rep), 1024):
            cell, row = grid_cells(thermometer(fp[at : at + 1024].view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(rep[at + row]), pa.array(fp[at + row])], ["cell", "rep", "f0"])


def _weighted_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("counts", "n"))
        for at in range(0, len(n), 1024):
            cell, row = grid_cells(counts[at : at + 1024].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(n[at + row])], ["cell", "n"])


def _near(fp: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs link: the Manhattan distance of the counts as a lower bound, then the fingerprints themselves."""
    near = manhattan(counts[i], counts[j]) <= distance
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count(fp[i[at]] ^ fp[j[at]]) <= distance
    return near


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Unites along the pairs; gives those that joined two trees."""
    made = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = _root(parent, x), _root(parent, y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            made.append((x, y))
    return made


def _linked(cell: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between rows of one cell; rows are sorted by cell."""
    n = len(cell)
    parent, counts = np.arange(n), thermometer(fp)
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(starts, n))
    edges: list[tuple[int, int]] = []
    small = np.repeat(sizes <= _SMALL_CELL, sizes)
    for step in range(1, int(min(sizes.max(initial=1), _SMALL_CELL))):
        i = np.flatnonzero((cell[step:] == cell[:-step]) & small[step:])
        if not len(i):
            break
        i = i[_near(fp, counts, i, i + step, distance)]
        edges += _joined(parent, i, i + step)
    for s, size in zip(starts[sizes > _SMALL_CELL].tolist(), sizes[sizes > _SMALL_CELL].tolist(), strict=True):
        order = s + np.argsort(fp[s : s + size])
        i = np.arange(size - 1)
        i = i[_near(fp, counts, order[i], order[i + 1], distance)]
        edges += _joined(parent, order[i], order[i + 1])
        roots = np.array([_root(parent, x) for x in range(s, s + size)])
        values, of_root = np.unique(roots, return_counts=True)
        main = values[np.argmax(of_root)]  # rows of the largest tree need no tests among themselves
        every = np.arange(s, s + size)
        for x in every[roots != main].tolist():
            hit = every[_near(fp, counts, np.full(size, x), every, distance)]
            hit = hit[hit != x]
            edges += _joined(parent, np.full(len(hit), x), hit)
    return edges


def _cell_links(distance: int):
    """Of rows sorted by cell: the edges of each cell's forest.  At most two blocks of HOT_CELL / 2 rows, or one cell, are held."""

    def forest(parts: list[pa.RecordBatch], whole: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(parts).combine_chunks()
        cell = t.column("cell").to_numpy()
        upto = len(cell) if whole or not len(cell) else int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
        fp, rep = t.column("f0").to_numpy()[:upto].view(np.uint64), t.column("rep").to_numpy()
        edges = np.array(_linked(cell[:upto], fp, distance), np.int64).reshape(-1, 2)
        ends = np.unique(np.sort(rep[edges], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"]), t.slice(upto).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, most = 0, 1 << 17
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= most:
                out, held = forest(held, False)
                rows = sum(x.num_rows for x in held)
                most = max(1 << 17, 2 * rows)
                yield out
        if rows:
            yield forest(held, True)[0]

    return run


def _dealt(met: DataFrame, classes: DataFrame, hot_cell: int) -> DataFrame:
    """met(cell, rep, f0) keyed for the tasks: a cell as it is, or one key for every two blocks of a hot cell."""
    f0 = F.col("f0")
    low = F.lit(0x5555555555555555).cast("bigint")
    high, own = F.shiftrightunsigned(f0, 1).bitwiseAND(low), f0.bitwiseAND(low)
    counts = high.bitwiseOR(own).bitwiseOR(F.shiftleft(high.bitwiseAND(own), 1))
    sizes = classes.groupBy(counts.alias("counts")).agg(F.count("*").alias("n"))
    hot = sizes.mapInArrow(_weighted_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > hot_cell)
    hot = materialize(hot.select(F.col("cell").alias("hot_cell"), F.ceil(F.col("n") * 2 / hot_cell).cast("int").alias("blocks")), "simhash-hot")
    rows = met.join(hot, met["cell"] == hot["hot_cell"], "left")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("cell", "rep", "f0", F.coalesce(block, F.lit(0)).alias("block"), F.explode(other).alias("other"))
    return rows.select("cell", F.least("block", "other").alias("block"), F.greatest("block", "other").alias("other"), "rep", "f0")


def fingerprints(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """(doc_id, f0): signed views of the unsigned 64-bit fingerprints."""
    python_stage(docs.sparkSession)
    return pick(docs, doc_id="bigint", text="string").mapInArrow(_fingerprints(params.shingle), "doc_id bigint, f0 bigint")


def range_join(classes: DataFrame, distance: int, hot_cell: int = HOT_CELL) -> DataFrame:
    """classes(rep, f0), distinct fingerprints -> (a, b): edges that connect all fingerprints within `distance` bits."""
    python_stage(classes.sparkSession)
    met = _dealt(classes.select("f0", "rep").mapInArrow(_cells, "cell bigint, rep bigint, f0 bigint"), classes, hot_cell)
    keyed = met.select(F.xxhash64("cell", "block", "other").alias("cell"), "rep", "f0")
    return keyed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams(), hot_cell: int = HOT_CELL) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, f0, component_id): one row per input row.

    component_id is the smallest doc_id reachable over links of at most params.distance differing bits, the row itself
    included.  Null text counts as empty.  Rows with a null doc_id get a fingerprint and the component of their equals, or
    null where only such rows have that fingerprint.  Repeated rows are one document.  An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, params), "simhash-fingerprints")
    classes = materialize(fps.groupBy("f0").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "simhash-classes")
    labels = connected_components(range_join(classes, params.distance, hot_cell))
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("f0", F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named, "simhash-named")
    return fps.join(named, "f0", "left").select("doc_id", "f0", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose group of near duplicates (five-word shingles, similarity 0.8) has a smaller doc_id.

    Rows with a null doc_id stay; all columns stay as they are.  See similar_texts.py for what links.
    """
    from chartloom.llm.similar_texts import similar_components

    gone = similar_components(docs).where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
