import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartloom.functions import lexicon as L
from chartloom.functions import literals, spans
from chartloom.functions.families import FAMILIES
from chartloom.operators.vocabulary import dictionary_mentions, family_mentions
from chartloom.sources.wide_notes import wide_notes

PATTERNS = ["(?i)" + f.pattern for f in FAMILIES] + [c.pattern for c in L.CONCEPTS]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("ab|cd", ("ab", "cd")), ("days?|wks?", ("day", "wk")), ("[ab]cd*ef", ("ef",)), ("x*", ()), ("(?:ab)?c", ()), ("(?:abc){2,3}", ("abc",)), ("a\\dbc", ("bc",)),
        ("\\d+", ()), ("ab|\\d", ()), ("(?:foo|bar)-?baz", ("bar-baz", "barbaz", "foo-baz", "foobaz")), ("(?<!x)abc(?=d)", ("abc",)), ("(", ()), ("éab|cd", ()), ("abc|xabcx", ("abc",)), ("(?i)Foo\\s+barn", ("barn",)),
    ],
)
def test_literals_that_a_match_needs(pattern, want):
    assert literals.required(pattern) == want


def test_nearly_all_patterns_have_literals():
    assert sum(bool(literals.required(p)) for p in PATTERNS) >= len(PATTERNS) - 2


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_holds_one(data):
    for p in PATTERNS:
        if needed := literals.required(p):
            text = data.draw(st.from_regex(re.compile(p, re.ASCII)))
            if text.isascii():
                assert any(x in text.lower() for x in needed), (p, text)


def test_the_guard_changes_no_row(spark, monkeypatch):
    notes = wide_notes(spark, "/root/testdata/sf0.001")
    with_guard = sorted(map(str, family_mentions(notes).collect()))
    monkeypatch.setattr(spans, "may_match", lambda text, pattern: F.lit(True))
    assert with_guard == sorted(map(str, family_mentions(notes).collect())) and with_guard


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 256, 300, 1000):
        rows = spark.createDataFrame([([k % 7 for k in range(n)],), (None,)], "a array<int>").select(spans.running(F.col("a")).alias("r")).collect()
        want, at = [], 0
        for k in range(n):
            at += k % 7
            want.append(at)
        assert rows[0]["r"] == want and rows[1]["r"] is None


def test_long_notes_keep_their_places_in_linear_time(spark):
    def seconds(n):
        text = " ".join(f"wörd{i % 100}" for i in range(n)) + ". pain 3/10"
        df = spark.createDataFrame([(1, text)], "note_id bigint, text string")
        own = df.select(spans.match_spans(F.col("text"), "[A-Za-z0-9]+").alias("m"))
        began = time.perf_counter()
        found = own.first()["m"]
        spent = time.perf_counter() - began
        assert len(found) == 2 * n + 3 and all(text[m["start"] : m["end"]] == m["text"] for m in found[:: max(1, n // 50)])
        assert dictionary_mentions(df).where("canonical_name = 'pain'").count() <= 1
        return spent

    seconds(500)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.25)


def test_a_text_may_be_null_or_hold_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",), ("nothing",)], "t string").select(spans.match_spans(F.col("t"), "(?i)pain").alias("m"), spans.sentence_spans(F.col("t")).alias("s")).collect()
    assert [r["m"] for r in rows] == [None, [], []] and rows[2]["s"][0]["text"] == "nothing"
