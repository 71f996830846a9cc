"""Token ids in Arrow stream files of fixed-size lists.

A store is a folder of shards, each a range of doc_ids: `shard-NNNNNN-ATTEMPT.arrow` is an Arrow IPC stream whose record batches all
hold SEQUENCES_A_BATCH rows (the last may hold fewer) of two fixed-size lists of `length` values: `ids` (uint16 where the
vocabulary fits, else uint32) and `mask` (bool, false on the padding that ends a shard).  The documents of a shard follow
one another in ascending doc_id order, each closed by the end id.  `shard-NNNNNN-ATTEMPT.docs.arrow` has doc_id, start and length
of each, counted within the shard.  Both map into memory: a sequence is a view of the mapped file, found by two divisions.

Encoding.  The GPT-2 pattern of byte-level vocabularies never lets a piece run over a space that stands before a sign that
is not white space: the space starts a new piece; and a line end with no white space beside it is a piece.  Texts are cut there, and the
library encodes each distinct piece once per worker (within a bound), which gives the ids of the whole text.

Writing.  Ids are made where the rows are read, compressed, and shuffled once to the task that owns their range of doc_ids.
A shard is written under a name of the attempt's own, and the manifest names the files of the attempts that ended: a task may
be repeated, or run twice, and nothing is renamed or deleted.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.bpe import byte_letters
from chartloom.llm.runtime import pick, python_stage

SEQUENCES_A_BATCH = 64
_PIECES_KEPT = 350_000
_MOST_SHARDS = 20_000

#: Texts with white space at a place where it may not begin a piece of its own, or with a special token, go whole.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NO_PIECES = rf"(?:\A|{_WHITE})\n|\n(?:{_WHITE}|\z)| (?:{_WHITE}|\z)|<\|"


class PieceEncoder:
    """Whole texts by the tokenizers library, each distinct piece encoded once (within a bound, in one worker).

    A batch of texts is cut into pieces and the pieces numbered in Arrow; only pieces that are new to the worker reach the
    library, and the ids of the texts are gathered from those of their pieces.  A piece of letters, with or without a full
    stop or comma behind, goes straight to the library's model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.tokenize = self.library.model.tokenize
        self.line = self._ids(["\n"])[0]
        self.ends = {c: self._ids([c])[0] for c in ".,"}
        self.letters = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, piece: str) -> bytes | None:
        """The ids of a piece of letters; None for any other."""
        tail = self.ends.get(piece[-1:], b"")
        word = piece[:-1] if tail else piece
        head = b""
        if word[:1] == "\n":
            head, word = self.line, word[1:]
        if not word.isalpha():
            return None
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(text if head else "\u0120" + text)]
        return head + array(self.code, ids).tobytes() + tail

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each as after a space, or as it stands where a line end begins it."""
        if len(self.known) > _PIECES_KEPT:
            self.older, self.known = self.known, {}
        known, older, word, odd = self.known, self.older, self._word, []
        out = list(map(known.get, pieces))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            p = pieces[i]
            ids = older.get(p) or word(p)
            if ids is None:
                odd.append(i)
            else:
                out[i] = known[p] = ids
        if odd:
            for i, ids in zip(odd, self._ids([p if p[:1] == "\n" else " " + p for p in map(pieces.__getitem__, odd)]), strict=True):
                out[i] = known[pieces[i]] = ids
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """For texts (null as empty), their ids as little-endian bytes of self.kind."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, _NO_PIECES)) if len(self.line) == self.kind.itemsize else pa.array([False] * len(texts))
        out: list[bytes] = [b""] * len(texts)
        where = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        for i, ids in zip(where.tolist(), self._plain(texts.take(pa.array(where))), strict=True):
            out[i] = ids
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        for i, ids in zip(rest.tolist(), self._ids(texts.take(pa.array(rest)).to_pylist()), strict=True):
            out[i] = ids
        return out

    def _plain(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds, numbered = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        first = bounds[:-1]
        first_pieces = numbered.take(pa.array(first)).to_pylist()  # a text's first piece follows no space
        index = numbered.indices.to_numpy().astype(np.int64)
        index[first] = len(numbered.dictionary) + np.arange(len(first))
        ids = self._pieces(numbered.dictionary.to_pylist()) + self._ids(first_pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        starts, own = np.cumsum(sizes) - sizes, sizes[index]
        ends = np.cumsum(own)
        gathered = flat[np.repeat(starts[index] - (ends - own), own) + np.arange(ends[-1])]
        at = np.concatenate(([0], ends))[bounds]
        return [gathered[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; add() takes documents in order, close() ends the files and gives their name."""

    def __init__(self, folder: str, shard: int, kind: str, length: int):
        self.fs, root = _open(folder)
        self.fs.create_dir(root)
        self.name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        self.made = f"{root}/{self.name}.arrow"
        self.kind, self.length = np.dtype(kind), length
        self.schema = pa.schema([("ids", pa.list_(pa.uint16() if self.kind.itemsize == 2 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.made)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.held, self.n_held, self.total = [], 0, 0
        self.docs: list[tuple[int | None, int, int]] = []

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        mask = pa.array(np.arange(len(ids)) < valid)
        self.stream.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        full = self.length * SEQUENCES_A_BATCH
        if self.n_held >= full:
            every = np.concatenate(self.held)
            for at in range(0, len(every) - full + 1, full):
                self._batch(every[at : at + full], full)
            rest = every[len(every) // full * full :]
            self.held, self.n_held = [rest], len(rest)

    def close(self) -> str:
        if self.n_held:
            ids = np.concatenate(self.held)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.kind)
            padded[: len(ids)] = ids
            self._batch(padded, len(ids))
        self.stream.close()
        self.sink.close()
        columns = list(zip(*self.docs, strict=True)) or [[], [], []]
        index = pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "length"), columns, strict=True)})
        with self.fs.open_output_stream(self.made.removesuffix(".arrow") + ".docs.arrow") as sink, pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        return self.name


class Shard:
    """Random access to a shard.  On a local or mounted file system nothing is copied: arrays are views of the mapped file."""

    def __init__(self, folder: str, name: str):
        fs, root = _open(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        source = lambda name: pa.memory_map(name) if local else fs.open_input_file(name)
        with pa.ipc.open_stream(source(f"{root}/{name}.docs.arrow")) as r:
            index = r.read_all()
        self.doc_ids, self.starts, self.lengths = index.column("doc_id").to_pylist(), index.column("start").to_numpy(), index.column("length").to_numpy()
        self.batches = list(pa.ipc.open_stream(source(f"{root}/{name}.arrow")))
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 1
        self.ids = [b.column("ids").flatten().to_numpy() for b in self.batches]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i."""
        batch, row = divmod(i, SEQUENCES_A_BATCH)
        at = row * self.length
        mask = self.batches[batch].column("mask").flatten().slice(at, self.length)
        return self.ids[batch][at : at + self.length], mask.to_numpy(zero_copy_only=False)

    def span(self, start: int, length: int) -> np.ndarray:
        """The ids from start on, over batches where need be."""
        full, out = self.length * SEQUENCES_A_BATCH, []
        while length > 0:
            batch, at = divmod(start, full)
            part = self.ids[batch][at : at + length]
            out.append(part)
            start, length = start + len(part), length - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)


def write_token_store(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, length: int = 2048, docs_a_shard: int = 4096) -> DataFrame:
    """Encode docs(doc_id, text, ...) and write the store; gives its manifest (shard, name, n_docs, n_tokens), one row per shard.

    Documents are in ascending doc_id order over the shards, those with a null doc_id first; rows that share a doc_id are
    ordered by token count and ids.  Null text is empty: the end id alone.  An empty table makes no shard.  vocabulary must
    be a path every executor has, folder a URI every executor and the driver can write and read.
    """
    spark = docs.sparkSession
    python_stage(spark)
    docs = pick(docs, doc_id="bigint", text="string")
    n = docs.select("doc_id").count()
    shards = min(_MOST_SHARDS, max(1, -(-n // docs_a_shard)))
    cuts = np.array(sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.2 / shards))) if n and shards > 1 else [], np.float64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = piece_encoder(vocabulary), zstandard.ZstdCompressor(level=3)
        end = np.array([end_id], encoder.kind).tobytes()
        for b in batches:
            ids = [x + end for x in encoder.encode(b.column("text"))]
            at = np.searchsorted(cuts, b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.float64), side="right")
            sizes = pa.array([len(x) // encoder.kind.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("doc_id"), sizes, pa.array([press.compress(x) for x in ids], pa.binary())], ["shard", "doc_id", "n_tokens", "ids"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, open_press = piece_encoder(vocabulary).kind, zstandard.ZstdDecompressor()
        writer, now = None, None
        done: list[tuple[int, str, int, int]] = []
        for b in batches:
            for shard, doc_id, ids in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if shard != now:
                    if writer:
                        done.append((now, writer.close(), len(writer.docs), writer.total))
                    writer, now = ShardWriter(folder, shard, kind, length), shard
                writer.add(doc_id, np.frombuffer(open_press.decompress(ids), kind))
        if writer:
            done.append((now, writer.close(), len(writer.docs), writer.total))
        columns = list(zip(*done, strict=True)) or [[], [], [], []]
        kinds = {"shard": pa.int32(), "name": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    kind = "shard int, name string, n_docs bigint, n_tokens bigint"
    ranged = docs.mapInArrow(encoded, "shard int, doc_id bigint, n_tokens bigint, ids binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens", "ids")
    done = ranged.mapInArrow(written, kind).collect()  # at most _MOST_SHARDS rows
    return spark.createDataFrame(done, kind)


def read_token_store(manifest: DataFrame, folder: str) -> DataFrame:
    """manifest: what write_token_store gave, held fast.  (doc_id, start, n_tokens, ids_crc32, shard), read back from the files: start counts over all shards, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, name, base in zip(*(b.column(c).to_pylist() for c in ("shard", "name", "base")), strict=True):
                shard = Shard(folder, name)
                for at in range(0, len(shard.doc_ids), 1024):
                    starts, lengths = shard.starts[at : at + 1024], shard.lengths[at : at + 1024]
                    crc = [zlib.crc32(shard.span(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[at : at + 1024], pa.int64()), pa.array(starts + base), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([number] * len(crc), pa.int32())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard, _MOST_SHARDS at most
    based = manifest.select("shard", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    spark = manifest.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    return based.repartition(parts, "shard").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int")
