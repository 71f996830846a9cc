"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with white space folded to single spaces.  An item of m signs has an error
budget of floor(rate * m) insertions, deletions and substitutions.  Cut into budget + 1 pieces of near equal length, at
least one piece of an item survives unchanged wherever the item occurs within its budget.  All pieces of all items go into
one Aho-Corasick automaton; each hit in a text points to the stretch where its item would lie, and Myers' bit-parallel
algorithm finds the smallest edit distance of the item to any part of that stretch.  Nothing within the budget is missed.

The items are broadcast in blocks of bounded size; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.runtime import pick, python_stage

ITEM_BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of the errors + 1 pieces; they cover the item."""
    n, k = len(item), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern_bits: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern inside text, if within `most` errors; the first of equals."""
    plus, minus, top, full = (1 << m) - 1, 0, 1 << (m - 1), (1 << m) - 1
    score, best = m, None
    get = pattern_bits.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class ItemMatcher:
    def __init__(self, items: tuple[tuple[int, str], ...], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()
        self.bits: dict[int, dict[str, int]] = {}

    def _pattern(self, n: int) -> dict[str, int]:
        if n not in self.bits:
            out: dict[str, int] = {}
            for i, c in enumerate(self.items[n][1]):
                out[c] = out.get(c, 0) | 1 << i
            self.bits[n] = out
        return self.bits[n]

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of every item found; the best place of each."""
        text = normalised(text)
        if not self.items or not text:
            return []
        stretches: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                _, item, errors = self.items[n]
                start = end + 1 - size - offset
                a, b = max(0, start - errors), min(len(text), start + len(item) + errors)
                known = stretches.setdefault(n, [])
                if known and a <= known[-1][1] and a >= known[-1][0]:
                    known[-1][1] = max(known[-1][1], b)  # hits of one item side by side share a stretch
                else:
                    known.append([a, b])
        found = []
        for n, own in stretches.items():
            item_id, item, errors = self.items[n]
            best = None
            for a, b in own:
                if b - a >= len(item) - errors and (hit := myers(self._pattern(n), len(item), text[a:b], errors)) and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                found.append((item_id, *best))
        return sorted(found)


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> ItemMatcher:
    return ItemMatcher(items, rate)


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[tuple[int, str], ...]]:
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.distinct().orderBy("item_id", "text").toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if block and size + len(text) > limit:
            yield tuple(block)
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield tuple(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = ITEM_BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text, ...) and benchmark(item_id, text, ...) -> (doc_id, item_id, distance, end), one row a pair found.

    end is where the best match ends in the normalised text.  Items and texts that are null or blank match nothing; items
    with a null id are left out; repeated rows of docs give repeated pairs.  Either table may be empty.
    """
    python_stage(docs.sparkSession)
    docs = pick(docs, doc_id="bigint", text="string").where("text is not null")
    kind = "doc_id bigint, item_id bigint, distance int, end int"
    out = None
    for block in _blocks(pick(benchmark, item_id="bigint", text="string").where("item_id is not null"), block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, rate)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in matcher.matches(t)]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["doc_id", "item_id", "distance", "end"])

        part = docs.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], kind)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """docs without the rows in which some item occurs within its budget.  Rows with a null doc_id stay."""
    gone = contaminated(docs, benchmark, rate).where("doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
