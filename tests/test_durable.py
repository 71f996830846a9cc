import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.functions import lexicon as L
from chartloom.operators import session_log as G
from chartloom.operators.features import RiskModel
from chartloom.operators.training import train_risk, training_report
from chartloom.streaming import mentions as S

NAMES = [n for n, *_ in L.RISK_FEATURES]
FEATURES = ", ".join(f"{n} double" for n in NAMES) + ", label int"


# training


def plain_descent(rows, epochs, rate=0.15, ridge=0.015):
    x = np.array([[(r[k] - c) / s for k, (_, _, c, s) in enumerate(L.RISK_FEATURES)] for r in rows])
    y, w, b = np.array([r[-1] for r in rows]), np.zeros(len(NAMES)), 0.0
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * (x.T @ error / len(y) + ridge * w), b - rate * error.mean()
    return b, w


@pytest.mark.parametrize("parts", [1, 7])
def test_weights_are_those_of_plain_descent(spark, monkeypatch, parts):
    monkeypatch.setattr("chartloom.operators.training._BLOCK", 16)
    rng = np.random.default_rng(parts)
    rows = [[float(v) for v in rng.uniform(0, 2, len(NAMES)) * [s for *_, s in L.RISK_FEATURES]] for _ in range(90)]
    for r in rows:
        r[NAMES.index("heart_rate__missing")] = r[NAMES.index("bp_missing")] = 0.0
        r.append(int(r[NAMES.index("phq9__max")] + rng.normal(0, 5) > 27))
    df = spark.createDataFrame([tuple(r) for r in rows], FEATURES).repartition(parts)
    model = train_risk(df, epochs=150)
    b, w = plain_descent(rows, 150)
    assert abs(model.intercept - b) < 1e-9 and max(abs(np.array([x[1] for x in model.features]) - w)) < 1e-9
    report = training_report(df, model).first()
    assert report["n"] == 90 and report["f1"] > 0.8 and 0 < report["accuracy"] <= 1


def test_training_without_usable_rows(spark):
    none = spark.createDataFrame([], FEATURES)
    assert train_risk(none, epochs=5).intercept == 0 and training_report(none, RiskModel()).first().asDict() == {"n": 0, "accuracy": 0, "precision": 0, "recall": 0, "f1": 0}
    odd = spark.createDataFrame([(*[None] * len(NAMES), 1), (*[float("nan")] * len(NAMES), 0), (*[float("inf")] * len(NAMES), None)], FEATURES)
    assert all(w == 0 for _, w, *_ in train_risk(odd, epochs=3).features)


# the session log


def log_of(spark, tmp_path, **k):
    return G.SessionLog(spark, f"file://{tmp_path}/log", **k)


def sessions(spark, *rows):
    return spark.createDataFrame([(i, f"{t}\nmore", t) for i, t in rows], "session_id string, text string, session string").withColumn("saved_at", F.lit("2024-01-01").cast("timestamp"))


def held(log):
    return {r["session_id"]: (r["name"], r["session"]) for r in log.sessions().collect()}


def test_saves_deletes_and_lookups(spark, tmp_path):
    log = log_of(spark, tmp_path)
    assert held(log) == {} and log.get("a").count() == 0
    log.snapshot()
    log.save(sessions(spark, ("a", "one"), ("b", "two"), (None, "no id")))
    log.save(sessions(spark, ("a", "three")))
    log.delete(spark.createDataFrame([("b",), ("not there",), ("b",)], "session_id string"))
    assert held(log) == {"a": ("three", "three")}
    log.save(sessions(spark, ("b", "four"), ("c", "x" * 70)))
    assert held(log_of(spark, tmp_path)) == {"a": ("three", "three"), "b": ("four", "four"), "c": ("x" * 61 + "...", "x" * 70)}
    assert log.get("b").first()["session"] == "four" and [r["session_id"] for r in log.listed().collect()] == ["a", "b", "c"]


def test_imports_save_what_is_valid(spark, tmp_path):
    good = json.dumps({"schemaVersion": "prototype-1", "specialty": "mixed", "sourceText": "\n first line \nx", "entities": []})
    files = spark.createDataFrame([("a", good), ("b", "{"), ("c", None), ("d", '{"specialty": 1}')], "session_id string, raw string").withColumn("saved_at", F.lit("2024-01-01").cast("timestamp"))
    log = log_of(spark, tmp_path)
    told = {r["session_id"]: r for r in log.take_in(files).collect()}
    assert {k: r["ok"] for k, r in told.items()} == {"a": True, "b": False, "c": False, "d": False} and told["b"]["errors"] == ["Import file is not valid JSON."]
    assert held(log) == {"a": ("first line", good)}


def test_a_snapshot_changes_nothing_and_old_batches_go(spark, tmp_path):
    log = log_of(spark, tmp_path, every=3)
    for i in range(8):
        log.save(sessions(spark, (f"s{i % 3}", f"text {i}")))
    log.delete(spark.createDataFrame([("s0",)], "session_id string"))
    assert held(log) == {"s1": ("text 7", "text 7"), "s2": ("text 5", "text 5")}
    log.snapshot()
    assert held(log) == {"s1": ("text 7", "text 7"), "s2": ("text 5", "text 5")}
    assert len(list(tmp_path.glob("log/log/*"))) == len(list(tmp_path.glob("log/batches/*"))) == 1
    log.save(sessions(spark, ("s0", "back")))
    assert held(log)["s0"] == ("back", "back")


@pytest.mark.parametrize("operation", ["save", "delete", "take_in", "snapshot"])
def test_a_crash_between_write_and_publish_leaves_the_state_before(spark, tmp_path, monkeypatch, operation):
    log = log_of(spark, tmp_path)
    log.save(sessions(spark, ("a", "one"), ("b", "two")))
    before = held(log)

    def crash(*_):
        raise OSError("crash")

    good = json.dumps({"schemaVersion": "prototype-1", "specialty": "mixed", "sourceText": "x", "entities": []})
    steps = {
        "save": lambda: log.save(sessions(spark, ("a", "new"))),
        "delete": lambda: log.delete(spark.createDataFrame([("a",)], "session_id string")),
        "take_in": lambda: log.take_in(spark.createDataFrame([("z", good)], "session_id string, raw string").withColumn("saved_at", F.current_timestamp())),
        "snapshot": log.snapshot,
    }
    monkeypatch.setattr(G, "_publish", crash)
    with pytest.raises(OSError, match="crash"):
        steps[operation]()
    monkeypatch.undo()
    assert held(log_of(spark, tmp_path)) == before
    steps[operation]()  # again, as one would after a crash
    now = held(log)
    assert now == {"save": {**before, "a": ("new", "new")}, "delete": {"b": before["b"]}, "take_in": {**before, "z": ("x", good)}, "snapshot": before}[operation]


def test_a_crash_before_the_sweep_and_a_batch_named_late(spark, tmp_path, monkeypatch):
    log = log_of(spark, tmp_path)
    log.save(sessions(spark, ("a", "one"), ("b", "one")))
    log.save(sessions(spark, ("a", "two")))
    late = log_of(spark, tmp_path)
    real = G._publish
    named = []
    monkeypatch.setattr(G, "_publish", lambda *a: named.append(a))
    late.save(sessions(spark, ("b", "late")))  # written, not named yet
    monkeypatch.setattr(G, "_publish", real)
    monkeypatch.setattr(G.SessionLog, "sweep", lambda self: None)
    log.delete(spark.createDataFrame([("a",)], "session_id string"))
    log.snapshot()
    assert held(log) == {"b": ("one", "one")}
    real(*named[0])
    assert held(log) == {"b": ("late", "late")}
    monkeypatch.undo()
    log.sweep()
    assert held(log) == {"b": ("late", "late")} and len(list(tmp_path.glob("log/log/*"))) == 2


# streams

TIMED = "id string, session_id string, seq bigint, text string, at timestamp"


def batches(spark, tmp_path, steps, transform, mode):
    """Runs a stream over one file a micro-batch; gives what came out and the rows in its state at the end."""
    folder = tmp_path / "in"
    folder.mkdir()
    out = spark.createDataFrame([], TIMED)
    query = None
    name = f"out_{tmp_path.name}".replace("-", "_")
    stream = transform(spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).json(str(folder)))
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, rows in enumerate(steps):
            (folder / f"{i}.json").write_text("".join(json.dumps(dict(zip(("id", "session_id", "seq", "text", "at"), r, strict=True))) + "\n" for r in rows))
            query.processAllAvailable()
        state = query.lastProgress["stateOperators"][0]
    finally:
        query.stop()
    del out
    return spark.table(name).collect(), state["numRowsTotal"], state["numRowsDroppedByWatermark"]


def at(minute, day=1):
    return f"2024-01-{day:02d}T{minute // 60:02d}:{minute % 60:02d}:00Z"


def test_an_idle_session_is_told_once_and_leaves_the_store(spark, tmp_path):
    steps = [
        [("1", "a", 1, "one", at(0)), ("2", "a", 2, "two", at(10)), ("3", "b", 1, "b one", at(5)), (None, None, 1, "x", at(1)), ("4", "b", 9, None, at(6))],
        [("5", "a", 3, "three", at(25))],
        [("6", "c", 1, "far on", at(300))],
        [("7", "a", 4, "too late", at(2)), ("8", "c", 2, "far on", at(301))],
        [("9", "a", 5, "anew", at(400)), ("10", "d", 1, "end", at(0, 2))],
        [("11", "d", 2, "end", at(1, 2))],
    ]
    rows, state, dropped = batches(spark, tmp_path, steps, S.session_periods, "append")
    got = sorted((r["session_id"], r["began"].minute, r["seq"], r["text"], r["n_requests"]) for r in rows)
    assert got == [("a", 0, 3, "three", 3), ("a", 40, 5, "anew", 1), ("b", 5, 1, "b one", 1), ("c", 0, 2, "far on", 2)]
    assert state == 1  # only d is still held
    in_time = [r for step in steps for r in step if r[3] != "too late"]
    table = spark.createDataFrame([json.dumps(dict(zip(("id", "session_id", "seq", "text", "at"), r, strict=True))) for r in in_time], "string").select(F.from_json("value", TIMED).alias("r")).select("r.*")
    twin = sorted((r["session_id"], r["began"].minute, r["seq"], r["text"], r["n_requests"]) for r in S.session_periods(table).collect())
    assert twin == sorted([*got, ("d", 0, 2, "end", 2)])


def test_repeated_requests_are_answered_once(spark, tmp_path):
    steps = [
        [("1", "a", 1, "one", at(0)), ("1", "a", 1, "one", at(1)), ("2", "a", 2, "two", at(3))],
        [("1", "a", 1, "one", at(50)), ("3", "b", 1, "three", at(20)), (None, "b", 1, "no id", at(20))],
        [("4", "b", 2, "far on", at(600))],
        [("5", "b", 3, "late", at(30)), ("4", "b", 2, "far on", at(601))],
        [("6", "b", 4, "end", at(602))],
    ]
    rows, state, dropped = batches(spark, tmp_path, steps, S.requests_once, "append")
    assert sorted(r["id"] for r in rows) == ["1", "2", "3", "4", "6"]
    assert state == 2  # ids 1 to 3 have left
    in_time = [r for step in steps for r in step if r[3] != "late"]
    table = spark.createDataFrame([json.dumps(dict(zip(("id", "session_id", "seq", "text", "at"), r, strict=True))) for r in in_time], "string").select(F.from_json("value", TIMED).alias("r")).select("r.*")
    twin = {r["id"]: r for r in S.requests_once(table).collect()}
    assert sorted(twin) == ["1", "2", "3", "4", "6"] and twin["1"]["at"].minute == 0


def test_a_silent_session_leaves_the_store_by_the_clock(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text("".join(json.dumps({"id": str(i), "session_id": who, "seq": i, "op": "extract", "text": "x"}) + "\n" for i, who in enumerate("abc")))
    stream = S.session_state(S.request_stream(spark, str(folder)), idle_ms=500).writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    query = stream.trigger(processingTime="1 second").start()
    try:
        held, until = [], time.time() + 60
        while (not held or held[-1] or not any(held)) and time.time() < until:
            time.sleep(0.5)
            held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"]]
        assert max(held) == 3 and held[-1] == 0
    finally:
        query.stop()
