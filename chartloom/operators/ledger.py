"""A ledger of what a language model has answered, so that a prompt is asked once, whatever becomes of tasks and jobs.

Below the ledger's folder, on storage that the driver and all executors share:

    open/<bucket>/<key>.json    an answer, published by a rename as soon as it has come
    folded/<name>/              answers of one ask() as Parquet
    log/<name>                  names the folded tables that count

A prompt's key is the hash of its text and of the model's name.  ask() leaves out prompts that the log's tables hold, deals the
rest by bucket, and calls the client.  A task looks into its buckets' open folders first, so an attempt that follows a lost one
goes on behind the last answer; two attempts at a time may both ask, and one answer stands, as both would write one file.  When
all are answered, the open files are folded: the table is written, named in the log, and only then are the open files deleted.
A crash before the log's entry leaves open files as they are; one behind it leaves files whose keys count once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators.lineage import shared_folder, ship

Client = Callable[[list[dict[str, str]]], str]
_ROW = "key string, answer string"


def prompt_key(messages: Column, model: str = "") -> Column:
    """The key of a prompt, array<struct<role, content>>, for a model."""
    return F.sha2(F.concat(F.lit(model + "\n"), F.to_json(messages)), 256)


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, 2)


def _publish(fs: pafs.FileSystem, path: str, text: str) -> None:
    """A file that is there as a whole or not at all."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        out.write(text.encode())
    fs.move(draft, path)


def _names(fs: pafs.FileSystem, folder: str, suffix: str = "") -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(suffix) and not f.base_name.endswith(".draft"))


class Ledger:
    """The ledger in a folder (a URI), or in a fresh one below the shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, (folder or shared_folder(spark, "ledger")).rstrip("/")
        fs, root = pafs.FileSystem.from_uri(self.folder)
        for part in ("open", "folded", "log"):
            fs.create_dir(f"{root}/{part}")

    def answers(self) -> DataFrame:
        """(key, answer) of everything in the log, a key once; an answer is null where the client had none to give."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        tables = [f"{self.folder}/folded/{name}" for name in _names(fs, f"{root}/log")]
        if not tables:
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(*tables).groupBy("key").agg(F.min("answer").alias("answer"))

    def ask(self, prompts: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
        """prompts(key, messages) -> (key, answer) of each; equal prompts are asked once.

        The client is made once a task, and only by tasks that have something to ask.  Its ValueError is an answer that did
        not come (null); any other exception fails the task, and what was answered stays.  Null keys are left out.
        """
        ship(self.spark)
        folder = self.folder
        new = prompts.where("key IS NOT NULL").groupBy("key").agg(F.first(F.to_json("messages")).alias("messages"))
        new = new.join(self.answers().select("key"), "key", "left_anti").withColumn("bucket", _bucket(F.col("key")))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, root = pafs.FileSystem.from_uri(folder)
            client, bucket, known = None, None, set()
            for pdf in batches:
                n = 0
                for key, messages, own in zip(pdf["key"], pdf["messages"], pdf["bucket"], strict=True):
                    if own != bucket:
                        bucket, at = own, f"{root}/open/{own}"
                        known = set(_names(fs, at, ".json"))
                        fs.create_dir(at)
                    if f"{key}.json" in known:
                        continue
                    client = client or make_client()
                    try:
                        answer = client(json.loads(messages))
                    except ValueError:
                        answer = None
                    _publish(fs, f"{at}/{key}.json", json.dumps({"key": key, "answer": answer}))
                    n += 1
                yield pd.DataFrame({"asked": [n]})

        new.repartition("bucket").sortWithinPartitions("bucket", "key").mapInPandas(run, "asked bigint").agg(F.sum("asked")).collect()
        self.fold()
        return prompts.select("key").distinct().join(self.answers(), "key")

    def fold(self) -> None:
        """Moves the open answers into a table of the log."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        buckets = [b for b in _names(fs, f"{root}/open") if _names(fs, f"{root}/open/{b}", ".json")]
        if not buckets:
            return
        held = self.spark.read.schema(_ROW).option("pathGlobFilter", "*.json").json([f"{self.folder}/open/{b}" for b in buckets])
        name = uuid.uuid4().hex
        held.groupBy("key").agg(F.min("answer").alias("answer")).write.parquet(f"{self.folder}/folded/{name}")
        folded = [r["file"] for r in held.select(F.input_file_name().alias("file")).distinct().select(F.element_at(F.split("file", "/open/"), -1).alias("file")).toLocalIterator()]
        _publish(fs, f"{root}/log/{name}", "")
        for file in folded:
            fs.delete_file(f"{root}/open/{file}")
