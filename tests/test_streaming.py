"""Streams give what the same rows give as a table."""

import json

from chartloom.sources.notes import checked_gold_mentions, read_gold_notes
from chartloom.streaming import mentions as S

ROWS = [
    {"id": "1", "session_id": "a", "seq": 1, "op": "extract", "text": "HR 72. Denies SI."},
    {"id": "2", "session_id": "a", "seq": 3, "op": "extract", "text": "BP 120/80"},
    {"id": "3", "session_id": "a", "seq": 2, "op": "extract", "text": "PHQ-9 4"},
    {"id": "4", "session_id": "b", "seq": 1, "op": "drop", "text": "x"},
    {"id": "5", "session_id": None, "seq": 1, "op": "extract", "text": None},
]


def write(folder, rows):
    folder.mkdir(exist_ok=True)
    for i, r in enumerate(rows):
        (folder / f"{i}.json").write_text(json.dumps(r) + "\n\n")


def drained(stream, name, tmp_path, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_of_requests(spark, tmp_path):
    write(tmp_path / "in", ROWS)
    table = spark.read.schema(S.REQUEST).json(str(tmp_path / "in"))
    drained(S.answered(S.request_stream(spark, str(tmp_path / "in"))), "answers", tmp_path, "append")
    key = lambda r: (r["id"], r["start_char"], r["entity_type"], r["assertion"])
    got = sorted(map(key, spark.table("answers").collect()))
    assert got == sorted(map(key, S.answered(table).collect())) and len(got) == 4
    assert {(r["id"], r["error"]) for r in S.refused(table).collect()} == {("4", "unknown-op"), ("5", "invalid-text")}


def test_session_state_keeps_the_newest(spark, tmp_path):
    write(tmp_path / "in", ROWS)
    drained(S.session_state(S.request_stream(spark, str(tmp_path / "in"))), "sessions", tmp_path, "update")
    newest = {}
    for r in spark.table("sessions").collect():
        if r["session_id"] not in newest or r["n_requests"] > newest[r["session_id"]][2]:
            newest[r["session_id"]] = (r["seq"], r["text"], r["n_requests"])
    table = spark.read.schema(S.REQUEST).json(str(tmp_path / "in"))
    assert newest == {r["session_id"]: (r["seq"], r["text"], r["n_requests"]) for r in S.session_table(table).collect()}


def test_gold_notes_from_json_lines(spark, tmp_path):
    good = {"source_id": "n1", "text": "HR 72", "mentions": [{"text": "HR 72", "entity_type": "vital", "start_char": 0, "end_char": 5, "assertion": "present"}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n")
    rows = checked_gold_mentions(read_gold_notes(spark, str(tmp_path))).collect()
    assert [(r["source_id"], r["text"], r["gold_idx"]) for r in rows] == [("n1", "HR 72", 0)]
    good["mentions"][0]["end_char"] = 4
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + "\n")
    try:
        checked_gold_mentions(read_gold_notes(spark, str(tmp_path))).collect()
        raise AssertionError("a wrong span went through")
    except Exception as e:  # noqa: BLE001
        assert "does not reproduce" in str(e)


def test_answers_are_written_once_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"id":"a","session_id":"s","seq":1,"op":"extract","text":"HR 72. Denies SI."}', '{"id":"b","op":"delete"}', '{"id":"c","op":"ping"}', '{"id":"d","op":"extract","text":"nothing"}']
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    S.write_answers(S.request_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {x["id"]: x for x in map(json.loads, (r["value"] for r in spark.read.text(str(tmp_path / "out")).select("value").collect()))}
    assert set(got) == {"a", "b", "c", "d"} and [m["text"] for m in got["a"]["result"]["mentions"]] == ["HR 72", "SI"]
    assert got["b"] == {"id": "b", "ok": False, "error": {"code": "unknown-op"}} and got["c"] == {"id": "c", "ok": True} and got["d"]["result"] == {"mentions": [], "entities": []}
