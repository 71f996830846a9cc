"""Byte-pair encoding and decoding with forced-boundary splitting.

The vocabulary is a `tokenizers` JSON file of a BPE model with word ends: NFC, white space folded, lower case, then runs of
letters, single numbers and runs of other signs, mapped to bytes, the last symbol of a word carrying the suffix.

Forced boundaries.  Two tables over byte pairs are filled from the vocabulary: pairs that stand side by side inside some
token, and the same for pairs whose second byte ends a word.  A merge makes a token, so no merge can ever join two bytes
whose pair is in no token: the word is cut there, the fragments are encoded independently and their ids concatenated.
White space is such a boundary too (it is dropped before merging), and so are the special tokens' strings, which stand for
themselves.  Fragments and white-space separated pieces are remembered, within fixed bounds, in each Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chartloom.llm.runtime import pick, python_stage, release

_KEPT = 400_000  # pieces and fragments remembered at most, each
_LONG = 48  # symbols from which merging goes through a heap

#: The byte-to-letter alphabet of byte-level vocabularies maps printable bytes to themselves.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next letter from U+0100 on."""
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in set(_PRINTABLE) else chr(next(free)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary file.  encode(text bytes) gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = _KEPT):
        self.kept = kept
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.plain = [vocab.get(c, -1) for c in letters]
        self.final = [vocab.get(c + self.suffix, -1) for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.joins = np.zeros((256, 256), bool)
        self.joins_final = np.zeros((256, 256), bool)
        for token in vocab:
            ends = token.endswith(self.suffix) and token != self.suffix
            raw = [byte_of[c] for c in (token[: -len(self.suffix)] if ends else token) if c in byte_of]
            for i in range(len(raw) - 1):
                (self.joins_final if ends and i == len(raw) - 2 else self.joins)[raw[i], raw[i + 1]] = True
        self._joins, self._joins_final = self.joins.tobytes(), self.joins_final.tobytes()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self.pieces: dict[bytes, bytes] = {}
        self.fragments: dict[tuple[bytes, bool], tuple[int, ...]] = {}
        self._byte_of = byte_of

    # -- encoding ---------------------------------------------------------------------------------------------------
    def fragments_of(self, word: bytes) -> list[tuple[bytes, bool]]:
        """The word cut at its forced boundaries; the flag marks the fragment that ends it."""
        joins, last, start, out = self._joins, len(word) - 1, 0, []
        for i in range(last - 1):
            if not joins[word[i] << 8 | word[i + 1]]:
                out.append((word[start : i + 1], False))
                start = i + 1
        if last and not self._joins_final[word[last - 1] << 8 | word[last]]:
            out.append((word[start:last], False))
            start = last
        out.append((word[start:], True))
        return out

    def _merged(self, fragment: bytes, final: bool) -> tuple[int, ...]:
        ids = [self.plain[b] for b in fragment]
        if final:
            ids[-1] = self.final[fragment[-1]]
        ids = [i for i in ids if i >= 0]
        return tuple(self._by_heap(ids) if len(ids) > _LONG else self._by_scan(ids))

    def _by_scan(self, ids: list[int]) -> list[int]:
        merges = self.merges
        while len(ids) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
                m = merges.get(pair)
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (m := merges.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a piece without ASCII white space."""
        out: list[int] = []
        for part in self.special_cut.split(piece) if self.special_cut and b"<" in piece else (piece,):
            if (own := self.special.get(part)) is not None:
                out.append(own)
                continue
            text = unicodedata.normalize("NFC", part.decode("utf-8", "replace"))
            for word in self.words.findall("".join(map(str.lower, text))):
                for key in self.fragments_of(word.encode()):
                    ids = self.fragments.get(key)
                    if ids is None:
                        ids = self._merged(*key)
                        if len(key[0]) <= 64:
                            if len(self.fragments) >= self.kept:
                                self.fragments.clear()
                            self.fragments[key] = ids
                    out += ids
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: bytes) -> bytes:
        known, out = self.pieces, []
        for piece in text.split():
            ids = known.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= 64:
                    if len(known) >= self.kept:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    # -- decoding ---------------------------------------------------------------------------------------------------
    def decode(self, ids: bytes) -> bytes:
        """As the library does for a file without a decoder: the ids' tokens, joined by spaces, in UTF-8."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_words(self, ids: bytes) -> str:
        """The text itself: word ends become spaces and letters become bytes again."""
        text = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode().replace(self.suffix, " ")
        return bytes(self._byte_of.get(c, 0x20) for c in text).decode("utf-8", "replace").rstrip(" ")


@lru_cache(maxsize=2)
def bpe(path: str, kept: int = _KEPT) -> ForcedBoundaryBPE:
    release()
    return ForcedBoundaryBPE(path, kept)


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = True, kept: int = _KEPT) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_tokens, ids binary, decoded string, ids_sha256, decoded_sha256).

    One row per input row, in any order.  Null text is empty: no tokens, the digests of nothing.  ids are little-endian
    unsigned 32-bit integers; with_ids=False leaves ids and decoded out.  kept bounds what a worker remembers, not what it gives.  vocabulary must be a path every executor has.
    """
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocabulary, kept)
        for b in batches:
            ids = [model.encode(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
            decoded = [model.decode(x) for x in ids]
            columns = {"doc_id": b.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            columns |= {"ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())}
            if with_ids:
                columns |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, kind)
