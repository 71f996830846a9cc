import json
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chartloom.operators import hybrid as H
from chartloom.operators.ledger import Ledger, prompt_key

GOOD = {"text": "HR", "entity_type": "vital", "start_char": 0, "end_char": 2, "normalized_text": "heart rate", "attributes": {"value": "72"}}


def verdicts(spark, answers):
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    return [(r["error"], r["mentions"]) for r in H.judged(rows).orderBy("i").collect()]


def test_answers_are_judged_as_a_whole(spark):
    answers = [json.dumps([GOOD]), json.dumps({"mentions": []}), json.dumps({"mentions": [{**GOOD, "start_char": "0", "end_char": 2.0, "section_context": None, "attributes": {"value": 72.5, "n": None}}]})]
    got = verdicts(spark, answers)
    assert [e for e, _ in got] == [None] * 3 and [len(m) for _, m in got] == [1, 0, 1]
    m = got[2][1][0]
    assert (m["start_char"], m["end_char"], m["assertion"], m["confidence_score"], m["attributes"]) == (0, 2, "present", 1.0, {"value": "72.5"})


@pytest.mark.parametrize("raw", [None, "nope", "3", '"x"', '{"mentions": 1}', '{"mentions": null}', '{"mentions": [], "more": 1}', "{}", "[1]", "[null]", "[[]]"])
def test_answers_that_are_no_list_of_mentions(spark, raw):
    ((error, mentions),) = verdicts(spark, [raw])
    assert error and mentions is None


CHANGES = [
    ({"end_char": 0}, "end_char"), ({"start_char": -1}, "start_char"), ({"start_char": 0.5}, "start_char"), ({"start_char": "x"}, "start_char"), ({"start_char": None}, "start_char"), ({"end_char": 10**12}, "end_char"),
    ({"text": " "}, "text"), ({"text": 5}, "text"), ({"entity_type": "nonsense"}, "entity_type"), ({"assertion": "maybe"}, "assertion"), ({"assertion": None}, "assertion"), ({"more": 1}, "fields"), ({"normalized_text": 3}, "normalized_text"),
    ({"confidence_score": 2}, "confidence"), ({"confidence_score": None}, "confidence"), ({"confidence_score": "high"}, "confidence"), ({"attributes": [1]}, "attributes"), ({"attributes": None}, "attributes"),
    ({"attributes": {"a": {}}}, "attributes"), ({"attributes": {" ": 1}}, "attributes"), ({"attributes": {"value": "999"}}, "heart rate"), ({"attributes": {}}, "heart rate"), ({"attributes": {"value": None}}, "heart rate"),
    ({"normalized_text": "blood-pressure", "attributes": {"systolic": 80, "diastolic": 120}}, "blood pressure"), ({"entity_type": "score", "attributes": {"scale": "foo", "value": 99999}}, "score"),
    ({"entity_type": "score", "attributes": {"scale": "PHQ 9", "value": 28}}, "nothing"), ({"entity_type": "score", "attributes": {"scale": "tug", "value": 301}}, "score"), ({"entity_type": "score", "attributes": {"scale": "PHQ_9", "value": "28"}}, "score"),
    ({"entity_type": "severity", "normalized_text": "pain rating", "attributes": {"value": 11}}, "pain"), ({"entity_type": "finding", "normalized_text": "manual muscle test", "attributes": {"value": "9/5"}}, "strength"),
    ({"entity_type": "finding", "normalized_text": "manual muscle test", "attributes": {"value": "4+/5"}}, "nothing"), ({"entity_type": "score", "attributes": {"scale": "phq-9", "value": None}}, "nothing"),
]


def test_each_rule_is_told_without_the_notes_words(spark):
    for (error, mentions), (change, said) in zip(verdicts(spark, [json.dumps([{**GOOD, "text": "secret", **c}]) for c, _ in CHANGES]), CHANGES, strict=True):
        if said == "nothing":
            assert error is None and len(mentions) == 1, change
        else:
            assert error.startswith("mention[0] type=") and said in error and mentions is None, (change, error)
            assert "secret" not in error and "nonsense" not in error


def test_a_note_is_tried_again_and_then_given_up(spark, tmp_path):
    notes = spark.createDataFrame([(1, "HR ok"), (2, "HR twice"), (3, "HR fails"), (4, None), (5, "HR ok"), (6, "HR raises")], "note_id bigint, text string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def make():
        def ask(messages):
            text, again = messages[-1]["content"].split("\n", 1)[1], "refused" in messages[0]["content"]
            (calls / f"{abs(hash((text, messages[0]['content'])))}-{len(list(calls.iterdir()))}").touch()
            if "raises" in text:
                raise ValueError("the words of the note")
            return "{" if "fails" in text or ("twice" in text and not again) else json.dumps([GOOD])

        return ask

    got = {r["note_id"]: r for r in H.model_answers(notes, make, retries=1).collect()}
    assert {k: (r["mentions"] and len(r["mentions"]), r["attempts"]) for k, r in got.items()} == {1: (1, 1), 2: (1, 2), 3: (None, 2), 4: (1, 1), 5: (1, 1), 6: (None, 2)}
    assert got[3]["error"] == "the answer is not JSON" and got[6]["error"] == "there was no answer"
    assert len(list(calls.iterdir())) == 8  # notes 1 and 5 are one prompt
    assert H.model_answers(notes.limit(0), make).count() == 0


def prompts(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(H.messages(F.col("text")).alias("messages"))
    return rows.select(prompt_key(F.col("messages")).alias("key"), "messages")


def test_a_second_run_asks_what_the_first_left_open(spark, tmp_path):
    ledger, calls = Ledger(spark, f"file://{tmp_path}/ledger"), tmp_path / "calls"
    calls.mkdir()

    def client(bad):
        def make():
            def ask(messages):
                text = messages[-1]["content"].split("\n", 1)[1]
                if text == bad:
                    raise RuntimeError("the connection broke")
                (calls / f"{text}-{len(list(calls.iterdir()))}").touch()
                return text.upper()

            return ask

        return make

    texts = [f"note {i}" for i in range(40)]
    with pytest.raises(Exception, match="the connection broke"):
        ledger.ask(prompts(spark, texts), client("note 17"))
    assert ledger.answers().count() == 0  # nothing is in the log
    some = len(list(calls.iterdir()))
    assert len(list(Path(tmp_path).glob("ledger/open/*/*.json"))) == some < 40
    got = Ledger(spark, ledger.folder).ask(prompts(spark, texts), client(None))
    assert sorted(r["answer"] for r in got.collect()) == sorted(t.upper() for t in texts)
    assert len(list(calls.iterdir())) == 40  # once a note over both runs
    ledger.ask(prompts(spark, texts), client("note 3"))  # nothing left to ask
    assert len(list(calls.iterdir())) == 40 and not list(Path(tmp_path).glob("ledger/open/*/*.json"))


def test_a_crash_around_the_log_entry_changes_nothing(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    make = lambda: lambda messages: "yes"
    monkeypatch.setattr("chartloom.operators.ledger._publish", _failing_for("/log/"))
    with pytest.raises(OSError):
        ledger.ask(prompts(spark, ["a", "b"]), make)
    monkeypatch.undo()
    assert ledger.answers().count() == 0
    kept = {p: p.read_text() for p in Path(tmp_path).glob("ledger/open/*/*.json")}
    ledger.fold()
    for p, text in kept.items():
        p.write_text(text)  # as if the deletes had not come to pass
    assert ledger.answers().count() == 2
    ledger.fold()
    assert ledger.answers().count() == 2 and ledger.ask(prompts(spark, ["a", "b", "a"]), make).count() == 2


def _failing_for(part):
    from chartloom.operators import ledger as module

    real = module._publish

    def publish(fs, path, text):
        if part in path:
            raise OSError("crash")
        real(fs, path, text)

    return publish


def test_a_task_that_fails_and_is_tried_again_asks_once_a_note(tmp_path):
    script = textwrap.dedent(
        f"""
        import os
        from pyspark.sql import SparkSession
        from chartloom.operators import hybrid as H
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        calls = {str(tmp_path)!r} + "/calls"
        os.makedirs(calls)
        def make():
            seen = [0]
            def ask(messages):
                seen[0] += 1
                if seen[0] == 6 and not os.path.exists(calls + "-failed"):
                    open(calls + "-failed", "w").close()
                    os._exit(3)  # the worker dies
                text = messages[-1]["content"].split("\\n", 1)[1]
                fd = os.open(calls + "/" + text, os.O_CREAT | os.O_EXCL)  # a second call for a note is an error
                os.close(fd)
                return "[]"
            return ask
        notes = spark.createDataFrame([(i, f"note {{i}}") for i in range(30)], "note_id bigint, text string")
        rows = H.model_answers(notes, make).collect()
        print(len(rows), all(r["mentions"] == [] and r["attempts"] == 1 for r in rows), len(os.listdir(calls)), os.path.exists(calls + "-failed"))
        """
    )
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, check=False, cwd=Path(__file__).resolve().parents[1])
    assert done.stdout.split() == ["30", "True", "30", "True"], done.stderr[-2000:]
