"""The library of saved sessions on shared storage: an append log with snapshots, whole after any crash.

Below the log's folder, which the driver and all executors share:

    batches/<name>/    rows of one operation: (session_id, op, saved_at, name, session, seq, batch)
    log/<seq>-<name>   names a batch that counts; its text is a JSON object with kind and, for a snapshot, the names it covers

A batch is written first and then named in the log by a rename, so that an operation counts as a whole or not at all.  What
counts for a session is its last operation, in order of (seq, batch); in one batch, that of the newest saved_at.  A snapshot is
a batch of each session's last operation, deletes included, so that a batch which was named late is still weighed by its own
seq.  Batches that a snapshot covers are not read, and are deleted once it is named.
"""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators.ledger import _names, _publish
from chartloom.operators.lineage import shared_folder
from chartloom.operators.sessions import session_name, validated

_ROW = "session_id string, op string, saved_at timestamp, name string, session string, seq bigint, batch string"


class SessionLog:
    """The log in a folder (a URI), or in a fresh one below the shared folder; every `every` batches it makes a snapshot."""

    def __init__(self, spark: SparkSession, folder: str | None = None, every: int = 64) -> None:
        self.spark, self.folder, self.every = spark, (folder or shared_folder(spark, "sessions")).rstrip("/"), every
        fs, root = pafs.FileSystem.from_uri(self.folder)
        for part in ("batches", "log"):
            fs.create_dir(f"{root}/{part}")

    # what the log says

    def _entries(self) -> list[tuple[int, str, dict]]:
        """(seq, batch, what) of the batches that count; at most `every` and what was named since."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        found = []
        for file in _names(fs, f"{root}/log"):
            seq, name = file.split("-", 1)
            try:
                with fs.open_input_stream(f"{root}/log/{file}") as source:
                    found.append((int(seq), name, json.loads(source.read())))
            except FileNotFoundError:  # a snapshot has come between: it covers this batch
                return self._entries()
        covered = {name for _, _, what in found for name in what.get("covers", ())}
        return [e for e in found if e[1] not in covered]

    def _operations(self) -> DataFrame:
        """Each session's last operation."""
        names = [f"{self.folder}/batches/{name}" for _, name, _ in self._entries()]
        if not names:
            return self.spark.createDataFrame([], _ROW)
        columns = [c.split()[0] for c in _ROW.split(", ")]
        rest = [c for c in columns if c != "session_id"]
        last = F.max_by(F.struct(*rest), F.struct("seq", "batch", F.coalesce("saved_at", F.lit(0).cast("timestamp")), F.col("session"))).alias("last")
        return self.spark.read.schema(_ROW).parquet(*names).groupBy("session_id").agg(last).select("session_id", "last.*")

    # operations

    def _append(self, rows: DataFrame, kind: str, covers: list[str] = (), keep_order: bool = False) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        seq = 1 + max((int(f.split("-", 1)[0]) for f in _names(fs, f"{root}/log")), default=0)
        name = uuid.uuid4().hex
        if not keep_order:
            rows = rows.where("session_id IS NOT NULL").withColumn("seq", F.lit(seq).cast("bigint")).withColumn("batch", F.lit(name))
        rows = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in _ROW.split(", ")])
        rows.write.parquet(f"{self.folder}/batches/{name}")
        _publish(fs, f"{root}/log/{seq:012d}-{name}", json.dumps({"kind": kind, "covers": list(covers)}))
        if kind != "snapshot" and sum(what["kind"] != "snapshot" for _, _, what in self._entries()) >= self.every:
            self.snapshot()

    def save(self, sessions: DataFrame) -> None:
        """sessions(session_id, saved_at, text, session): session is kept as it is; its name comes from text."""
        self._append(sessions.select("session_id", F.lit("save").alias("op"), "saved_at", session_name(F.coalesce("text", F.lit(""))).alias("name"), "session"), "save")

    def delete(self, ids: DataFrame) -> None:
        """ids(session_id): those sessions are gone, whatever was saved before; ids that are not there do no harm."""
        none = F.lit(None)
        self._append(ids.select("session_id", F.lit("delete").alias("op"), none.alias("saved_at"), none.alias("name"), none.alias("session")).distinct(), "delete")

    def take_in(self, files: DataFrame) -> DataFrame:
        """files(session_id, saved_at, raw) -> (session_id, ok, errors, warnings); those that are ok are saved, in one batch."""
        from chartloom.operators.lineage import cut_lineage

        told = cut_lineage(files.join(validated(files.select("session_id", "raw")), "session_id"))
        self.save(told.where("ok").select("session_id", "saved_at", F.col("source_text").alias("text"), F.col("raw").alias("session")))
        return told.select("session_id", "ok", "errors", "warnings")

    def snapshot(self) -> None:
        """Folds all batches that count into one; a no-op on an empty log."""
        covered = self._entries()
        if not covered:
            return
        self._append(self._operations(), "snapshot", [name for _, name, _ in covered], keep_order=True)
        self.sweep()

    def sweep(self) -> None:
        """Deletes batches that a snapshot covers, their entries first; a crash here leaves what the next one deletes."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        counts = {name for _, name, _ in self._entries()}
        for file in _names(fs, f"{root}/log"):
            name = file.split("-", 1)[1]
            if name not in counts:
                fs.delete_file(f"{root}/log/{file}")
                fs.delete_dir(f"{root}/batches/{name}")

    # reading

    def sessions(self) -> DataFrame:
        """(session_id, saved_at, name, session) of what is there; listed(), with an order."""
        return self._operations().where("op = 'save'").select("session_id", "saved_at", "name", "session")

    def listed(self) -> DataFrame:
        """All sessions, the newest first, ties by id."""
        return self.sessions().orderBy(F.desc("saved_at"), "session_id")

    def get(self, session_id: str) -> DataFrame:
        """The session, one row or none."""
        return self.sessions().where(F.col("session_id") == session_id)
