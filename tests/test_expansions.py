import json

import pytest

from chartloom.sources import quarantine as Q
from chartloom.sources.expansions import RecordedExpansions, read_expansions, record_expansions


def page(*entries):
    return json.dumps({"expansion": {"contains": [{"system": "x", "code": c, "display": d} for c, d in entries]}})


@pytest.fixture
def folder(tmp_path):
    for system, files in {"LOINC": {"a": [page(("1", "one"), ("2", "two")), "no json", page(("3", "three"))], "b": ["{}", "[]", "null", page(("4", None), ("", "x"), ("5", "five"))]}, "CPT": {"a": [page(("9", "nine"))]}, "RxNorm": {"a": []}}.items():
        own = tmp_path / "pages" / f"system={system}"
        own.mkdir(parents=True)
        for name, lines in files.items():
            (own / name).write_text("\n".join(lines))
        (own / "_SUCCESS").touch()
    return f"file://{tmp_path}/pages"


def test_pages_are_rows_of_their_system(spark, folder):
    got = sorted((r["system"], r["file"], r["page"], r["ord"], r["code"], r["display"]) for r in read_expansions(spark, folder).collect())
    assert got == [("CPT", "a", 0, 0, "9", "nine"), ("LOINC", "a", 0, 0, "1", "one"), ("LOINC", "a", 0, 1, "2", "two"), ("LOINC", "a", 2, 0, "3", "three"), ("LOINC", "b", 3, 2, "5", "five")]
    assert read_expansions(spark, folder).rdd.getNumPartitions() == 4


def test_filters_on_system_are_pushed_down(spark, folder, capsys):
    rows = read_expansions(spark, folder)
    for where, n, files in (("system = 'LOINC'", 4, 2), ("system IN ('CPT', 'RxNorm')", 1, 2), ("system = 'none'", 0, None), ("system = 'CPT' AND code > '1'", 1, 1), ("system = 'CPT' AND system = 'LOINC'", 0, None)):
        df = rows.where(where)
        assert df.count() == n, where
        if files:
            assert df.rdd.getNumPartitions() == files
    rows.where("system = 'LOINC' AND code > '1'").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [EqualTo(system,LOINC)]" in plan
    assert "(system#" not in plan.split("Condition :")[1].split("\n")[0].replace("isnotnull(system#", "")  # what is pushed is not checked again


def test_recorded_entries_come_back(spark, tmp_path):
    entries = [("CPT", i, str(i), f"name {i}") for i in range(250)]
    folder = f"file://{tmp_path}/out"
    record_expansions(spark.createDataFrame(entries, "system string, ord int, code string, display string"), folder, 100)
    got = read_expansions(spark, folder).collect()
    assert sorted(int(r["code"]) for r in got) == list(range(250)) and all(int(r["code"]) % 100 == r["ord"] for r in got)
    assert RecordedExpansions.name() == "recorded-expansions"


def test_each_line_is_a_note_or_in_quarantine(spark, tmp_path):
    good = {"source_id": "n1", "text": "HR 72", "mentions": [{"text": "HR 72", "entity_type": "vital", "start_char": 0, "end_char": 5, "assertion": "present"}]}
    change = lambda **k: json.dumps({**good, **k})
    mention = lambda **k: change(mentions=[good["mentions"][0], {**good["mentions"][0], **k}])
    bad = {
        "{": "not JSON", "[1]": "no object", "3": "no object", change(source_id=None): "source_id", change(text=5): "text is missing", change(mentions={}): "no list", change(mentions=[1]): "mention 0 is no object", mention(text=None): "mention 1 lacks",
        mention(end_char=None): "mention 1 has no span", mention(end_char=0): "mention 1 has no span", mention(end_char=4): "mention 1 has a span that does not", mention(start_char="0"): "mention 1 has no span",
    }
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([json.dumps(good), "", *bad, "  "]))
    (tmp_path / "in" / "sub" / "b.jsonl").write_bytes(change(mentions=[]).encode() + b"\r\n\xff\xfe\n" + json.dumps({"source_id": "n2", "text": ""}).encode())
    (tmp_path / "in" / "_SUCCESS").touch()
    records = Q.read_records(spark, f"file://{tmp_path}/in")
    notes, out = Q.sorted_out(records)
    assert records.count() == 1 + len(bad) + 3 == notes.count() + out.count()
    got = {(r["file"], r["line"]): r for r in out.collect()}
    for line, (raw, said) in enumerate(bad.items(), 3):
        r = got.pop(("a.jsonl", line))
        assert r["raw"] == raw and said in r["reason"], (raw, r["reason"])
    assert [(k, r["reason"]) for k, r in got.items()] == [(("sub/b.jsonl", 2), "the line is not JSON")]
    kept = {(r["file"], r["line"]): r for r in notes.collect()}
    assert set(kept) == {("a.jsonl", 1), ("sub/b.jsonl", 1), ("sub/b.jsonl", 3)} and kept["a.jsonl", 1]["mentions"][0]["end_char"] == 5
