"""Delta-maintained token counts by source, language and tokenizer version.

A rollup is a folder of committed batches.  A batch holds signed totals (documents, characters, tokens) by source, lang and
tokenizer: inserts count plus, deletes minus, and a revised count minus the old and plus the new.  Totals are the sums over
all batches, so they can be kept up in any order and never need the documents again.

Commits.  A batch's totals are written under a name of the attempt's own in data/.  What counts is its entry in log/, a small
file named by the hash of the batch id that holds the id and the data's name: it is written beside and moved into place by a
rename that fails where the entry exists, which HDFS and local disks do in one step (on a plain object store, let one writer
commit at a time).  So a batch may be sent again after any failure and counts once, and its id is never forgotten.

Compaction.  compact() writes the sum of all data read so far, then publishes the next file in folds/, again by such a rename:
it names the folded data and all data that it stands for.  Readers take the last fold and the entries it does not stand for.
Replaced data is deleted by the compaction after that, so that readers at work keep their files; a crash at any point leaves
the totals whole, and batches committed meanwhile count on.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.runtime import python_stage
from chartloom.llm.token_store import piece_encoder

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_chars", "n_tokens")
_SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_chars bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, vocabulary: str, tokenizer: str) -> DataFrame:
    """docs(doc_id, text, source, lang, ...) -> (doc_id, source, lang, tokenizer, n_chars, n_tokens), whole texts, null as empty."""
    python_stage(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary)
        size = encoder.kind.itemsize
        for b in batches:
            n = [len(x) // size for x in encoder.encode(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "source", "lang", "n_chars")] + [pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_chars", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.col("text").cast("string"))
    counted = rows.mapInArrow(run, "doc_id bigint, source string, lang string, n_chars bigint, n_tokens bigint")
    return counted.withColumn("tokenizer", F.lit(tokenizer))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("n_docs"), "n_chars", "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("n_docs"), (-F.col("n_chars")).alias("n_chars"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


def summed(deltas: DataFrame) -> DataFrame:
    """Signed totals by key; partial sums are taken where the rows are, so that a key with many rows is no hot task."""
    return deltas.groupBy(*KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])


class TokenRollup:
    """folder: a URI on storage that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        for part in ("data", "log", "folds"):
            self._fs.mkdirs(self._path(part))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _names(self, part: str) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(part)) if (n := s.getPath().getName())[0] not in "._")

    def _said(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, name: str, what: dict) -> bool:
        """Write a small file as a whole; False where it exists already."""
        part, _, own = name.partition("/")
        made = self._path(f"{part}/.{own}-{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(made, self._path(name), no_options)
        except Py4JJavaError as e:
            self._fs.delete(made, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def _fold(self) -> dict:
        names = self._names("folds")
        return self._said(f"folds/{names[-1]}") if names else {"number": 0, "data": [], "replaces": []}

    def _live(self) -> tuple[dict, list[str]]:
        """The last fold, and the names of the data that counts.  Both are read again if a fold came between."""
        while True:
            fold = self._fold()
            gone = set(fold["replaces"])
            entries = [self._said(f"log/{n}")["data"] for n in self._names("log")]
            if self._fold()["number"] == fold["number"]:
                return fold, fold["data"] + [d for d in entries if d not in gone]

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.folder}/data/{n}" for n in names]) if names else self.spark.createDataFrame([], _SCHEMA)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        summed(rows).coalesce(1).write.parquet(f"{self.folder}/data/{name}")  # a row a key
        return name

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"log/{hashlib.sha256(batch_id.encode()).hexdigest()}"))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch; False, and nothing done, where the id is committed already.  deltas: KEYS and signed SUMS.

        Null keys are keys of their own; null sums count as zero; repeated rows count each; other columns are ignored; an
        empty batch is committed all the same.
        """
        if self.committed(batch_id):
            return False
        name = self._write(deltas.select(*KEYS, *SUMS).na.fill(0, list(SUMS)))
        done = self._publish(f"log/{hashlib.sha256(batch_id.encode()).hexdigest()}", {"id": batch_id, "data": name})
        if not done:
            self._fs.delete(self._path(f"data/{name}"), True)
        return done

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_chars, n_tokens); keys that have come down to nothing are left out."""
        return summed(self._read(self._live()[1])).where(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> bool:
        """Fold all batches into one; False where another fold was published first.  Commits may go on meanwhile."""
        fold, names = self._live()
        name = self._write(self._read(names))
        replaces = sorted({*fold["replaces"], *names})
        if not self._publish(f"folds/{fold['number'] + 1:09d}", {"number": fold["number"] + 1, "data": [name], "replaces": replaces}):
            self._fs.delete(self._path(f"data/{name}"), True)
            return False
        for old in fold["replaces"]:
            self._fs.delete(self._path(f"data/{old}"), True)
        return True
