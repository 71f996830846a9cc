"""Notes as a stream: JSON request lines to answers, and session state that keeps the latest request of each session."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chartloom.operators.documents import envelope, request_error
from chartloom.operators.extraction import extract_mentions
from chartloom.operators.lineage import ship

REQUEST = "id string, session_id string, seq bigint, op string, text string"


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON Lines files that arrive in a folder, a request a line."""
    return spark.readStream.schema(REQUEST).json(folder)


def answered(requests: DataFrame) -> DataFrame:
    """requests (a stream or a table) -> one row a mention of each valid extract request; stateless, so it streams as it is."""
    valid = requests.where((F.col("op") == "extract") & request_error(F.col("op"), F.col("text")).isNull())
    return extract_mentions(valid, keep=("id", "session_id", "seq"))


def refused(requests: DataFrame) -> DataFrame:
    """(id, error) of the requests that are refused."""
    return requests.select("id", request_error(F.col("op"), F.col("text")).alias("error")).where("error IS NOT NULL")


def _newest(idle_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    seq, text, n = state.get if state.exists else (-1, "", 0)
    for pdf in batches:
        n += len(pdf)
        last = pdf.sort_values("seq").iloc[-1]
        if last["seq"] >= seq:
            seq, text = int(last["seq"]), last["text"]
    state.update((seq, text, n))
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame({"session_id": [key[0]], "seq": [seq], "text": [text], "n_requests": [n]})


def session_state(requests: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of each session's newest request and how many it has sent; updates as batches arrive.

    With idle_ms, a session that has sent nothing for so long by the clock leaves the store, and counts anew when it sends
    again; the query then needs a trigger with an interval, as each trigger looks for such sessions, new requests or not.
    Without it, and with the availableNow trigger, the store keeps all sessions; session_periods is bounded by event time.
    """
    ship(requests.sparkSession)
    kind = "session_id string, seq bigint, text string, n_requests bigint"
    grouped = requests.where("session_id IS NOT NULL AND text IS NOT NULL").groupBy("session_id")
    return grouped.applyInPandasWithState(partial(_newest, idle_ms), kind, "seq bigint, text string, n bigint", "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def session_table(requests: DataFrame) -> DataFrame:
    """What session_state comes to, over a table."""
    rows = requests.where("session_id IS NOT NULL AND text IS NOT NULL")
    return rows.groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"), F.count("*").alias("n_requests"))


def session_periods(requests: DataFrame, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """requests(session_id, seq, text, at) -> (session_id, began, ended, seq, text, n_requests): a row for each time that a
    session was at work, told when it has been idle; text is that of the highest seq (of the highest text, in a tie).

    On a stream, a period is told and leaves the store once the watermark, `late` behind the newest row, is past its end
    (the last request and `idle`).  A row that came more than `idle` before the watermark is dropped; on a table no row is
    late.  Rows without session_id, at or text are left out.
    """
    rows = requests.where("session_id IS NOT NULL AND at IS NOT NULL AND text IS NOT NULL").withWatermark("at", late)
    newest = F.max(F.struct(F.col("seq"), F.col("text")))
    held = rows.groupBy("session_id", F.session_window("at", idle).alias("w")).agg(newest.alias("newest"), F.count("*").alias("n_requests"))
    return held.select("session_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "newest.seq", "newest.text", "n_requests")


def requests_once(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """requests(id, at, ...) with each id once: a request that a client sends again is answered once.

    On a stream, ids are held until the watermark, `late` behind the newest row, has passed their first row's time by `late`,
    so that the store holds the ids of that time only; a row older than the watermark is dropped.  On a table, the earliest
    row of each id stays.  Rows without id or at are left out.
    """
    rows = requests.where("id IS NOT NULL AND at IS NOT NULL")
    if rows.isStreaming:
        return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    rest = [F.col(c) for c in rows.columns if c not in ("id", "at")]
    return rows.groupBy("id").agg(F.min(F.struct("at", *rest)).alias("_first")).select("id", "_first.*").select(*rows.columns)


def answers(requests: DataFrame) -> DataFrame:
    """requests (a table, or a micro-batch) -> (id, ok, body): one JSON answer a request.

    Body: id, ok, and result (mentions and entities of the note) for extract, error (code) where the request is refused, and
    neither for ping.  Requests of one id must be one request.
    """
    code = request_error(F.col("op"), F.col("text"))
    rows = requests.select("id", "op", "text", code.alias("code"))
    bodies = envelope(extract_mentions(rows.where("code IS NULL AND op = 'extract'").withColumnRenamed("id", "note_id")), requests.sparkSession)
    told = rows.join(bodies.withColumnRenamed("note_id", "id"), "id", "left")
    result = F.when((F.col("op") == "extract") & F.col("code").isNull(), F.coalesce("body", F.lit('{"mentions":[],"entities":[]}')))
    head = F.to_json(F.struct("id", F.col("code").isNull().alias("ok"), F.when(F.col("code").isNotNull(), F.struct("code")).alias("error")))
    tail = F.coalesce(F.concat(F.lit(',"result":'), result), F.lit(""))
    return told.select("id", F.col("code").isNull().alias("ok"), F.concat(F.substr(head, F.lit(1), F.length(head) - 1), tail, F.lit("}")).alias("body"))


def write_answers(requests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of requests into JSON Lines files, a folder a micro-batch; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        answers(batch).select("body").write.mode("overwrite").text(f"{folder}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
