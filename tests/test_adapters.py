import pytest
from pyspark.sql import functions as F

from chartloom.operators import adapters as A
from chartloom.operators.context import note_context
from chartloom.operators.extraction import merge_mentions, remap_to_source
from chartloom.operators.vocabulary import laterality


def test_plausible_values(spark):
    rows = [("severity", "pain rating", {"value": "99"}, False), ("severity", "pain rating", {"value": "6"}, True), ("vital", "blood pressure", {"measurement": "blood-pressure", "systolic": "80", "diastolic": "120"}, False), ("vital", "heart rate", {"value": "72"}, True), ("score", "PHQ-9", {"value": "30", "scale": "PHQ-9"}, False), ("problem", "x", {}, True)]
    df = spark.createDataFrame([(*r,) for r in rows], "entity_type string, normalized_text string, attributes map<string,string>, want boolean")
    m = F.struct(F.lit("t").alias("text"), "entity_type", F.lit(0).alias("start_char"), F.lit(1).alias("end_char"), F.lit(0.5).alias("confidence_score"), "normalized_text", "attributes")
    assert all(r["ok"] == r["want"] for r in df.withColumn("m", m).select("want", A.plausible(F.col("m")).alias("ok")).collect())


def test_token_spans_must_be_whole(spark):
    kind = "word string, start int, end int, entity_group string, score double"
    assert A.from_token_spans(spark.createDataFrame([("HR", 0, 2, "vital", None)], kind)).first()["confidence_score"] == 1.0
    with pytest.raises(Exception, match="token span lacks"):
        A.from_token_spans(spark.createDataFrame([("HR", None, 2, "vital", None)], kind)).collect()


def test_merge_prefers_primary_and_earlier(spark):
    kind = "note_id bigint, entity_type string, canonical_text string, start_char int, end_char int, idx int"
    p = spark.createDataFrame([(1, "risk", "si", 0, 2, 0)], kind)
    s = spark.createDataFrame([(1, "risk", "si", 1, 3, 0), (1, "risk", "si", 5, 9, 1), (1, "risk", "si", 6, 8, 2), (1, "risk", "other", 0, 2, 3)], kind)
    assert sorted((r["side"], r["canonical_text"], r["start_char"]) for r in merge_mentions(p, s).collect()) == [(0, "si", 0), (1, "other", 0), (1, "si", 5)]


def test_remap_moves_forward_through_repeated_lines(spark):
    rows = [(1, "A b. C d. A b.", "A b.\nA b.", "A", 5, 6), (1, "A b. C d. A b.", "A b.\nA b.", "b", 2, 3), (1, "A b.", "zzz", "z", 0, 1)]
    df = spark.createDataFrame(rows, "note_id bigint, text string, compressed_text string, m_text string, m_start int, m_end int")
    assert sorted((r["m_text"], r["start_char"]) for r in remap_to_source(df).collect()) == [("A", 10), ("b", 2)]


def test_laterality_needs_a_body_site(spark):
    df = spark.createDataFrame([("pain", "Right knee pain"), ("pain", "He left the clinic"), ("pain", "bilat hip and left arm")], "m string, s string")
    assert [r[0] for r in df.select(laterality(F.col("m"), F.col("s"))).collect()] == ["right", None, "bilateral"]


def test_context_and_ambiguous_abbreviations(spark):
    notes = spark.createDataFrame([(1, "PT reports HEP done, ROM improved. PT referral for therapy."), (2, "CP, SOB, BP 120/80. HTN."), (3, "nothing")], "note_id bigint, text string")
    got = {r["note_id"]: r for r in note_context(notes).collect()}
    assert got[1]["primary_specialty"] == "physical-therapy" and got[3]["primary_specialty"] == "mixed" and got[3]["abbreviations"] == []
    assert [(a["abbreviation"], a["meaning"]) for a in got[2]["abbreviations"]] == [("CP", "chest pain")]
    assert {a["abbreviation"]: a["n"] for a in got[1]["abbreviations"]} == {"PT": 2, "ROM": 1}
