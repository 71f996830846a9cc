"""Assertion sentences, edge cases of the operators, and small worked examples."""

import pytest
from pyspark.sql import functions as F

from chartloom.functions.lexicon import Concept
from chartloom.functions.spans import any_of, char_jaccard, match_spans, sentence_spans, token_jaccard
from chartloom.operators import evaluation as E
from chartloom.operators import features as X
from chartloom.operators import rollup as R
from chartloom.operators.extraction import extract_mentions, triage
from chartloom.operators.validation import strength_grade

SENTENCES = [
    ("Patient denies chest pain.", "chest pain", "absent"),
    ("No evidence of pneumonia.", "pneumonia", "absent"),
    ("Mother had breast cancer.", "breast cancer", "family-history"),
    ("Denies family history of cancer.", "cancer", "absent"),
    ("Chest pain with exertion.", "Chest pain", "conditional"),
    ("No chest pain with exertion.", "chest pain", "absent"),
    ("Rule out pneumonia.", "pneumonia", "hypothetical"),
    ("Return precautions for fever.", "fever", "hypothetical"),
    ("History of MI.", "MI", "historical"),
    ("No history of MI.", "MI", "absent"),
    ("History of hypertension, on lisinopril.", "hypertension", "present"),
    ("History of hypertension on admission.", "hypertension", "historical"),
    ("Pneumonia has resolved.", "Pneumonia", "historical"),
    ("Possible pneumonia.", "pneumonia", "possible"),
    ("No possible pneumonia.", "pneumonia", "possible"),
    ("Fever is denied.", "Fever", "absent"),
    ("Denies fever but reports cough.", "cough", "present"),
    ("Not only fever was seen.", "fever", "present"),
    ("Cannot rule out PE.", "PE", "hypothetical"),
    ("Cough, which the family and the patient later on and repeatedly denied.", "Cough", "unknown"),
    ("Headache was smothered by work.", "Headache", "present"),
]


@pytest.mark.parametrize(("text", "phrase", "want"), SENTENCES)
def test_assertion_of_sentence(spark, text, phrase, want):
    notes = spark.createDataFrame([(1, text)], "note_id bigint, text string")
    row = extract_mentions(notes, [Concept("problem", r"\b" + phrase + r"\b", phrase)]).collect()
    assert [r["assertion"] for r in row] == [want]


def test_nulls_blanks_and_empty_tables(spark):
    notes = spark.createDataFrame([(1, None), (2, ""), (3, "   \n "), (4, "HR 72")], "note_id bigint, text string")
    assert [(r["note_id"], r["start_char"], r["end_char"]) for r in extract_mentions(notes).collect()] == [(4, 0, 5)]
    assert extract_mentions(notes.limit(0)).count() == 0
    assert R.rollup(extract_mentions(notes.limit(0))).count() == 0


def test_offsets_count_code_points(spark):
    notes = spark.createDataFrame([(1, "😀 é HR 72; HR 80")], "note_id bigint, text string")
    rows = sorted((r["start_char"], r["text"]) for r in extract_mentions(notes).collect())
    assert rows == [(4, "HR 72"), (11, "HR 80")]


def test_sentences_keep_decimals(spark):
    row = spark.createDataFrame([("A1c 7.8 today. Next!\n\nLast line",)], "t string").select(sentence_spans(F.col("t")).alias("s")).first()
    assert [(x["start"], x["end"], x["text"]) for x in row["s"]] == [(0, 14, "A1c 7.8 today."), (15, 20, "Next!"), (22, 31, "Last line")]


def test_phrases_are_whole_words(spark):
    df = spark.createDataFrame([("smothered mother w/o r/o rule   out",)], "t string")
    found = df.select(match_spans(F.col("t"), any_of(["mother", "w/o", "r/o", "rule out"])).alias("m")).first()["m"]
    assert [x["text"] for x in found] == ["mother", "w/o", "r/o", "rule   out"]
    assert df.select(F.col("t").rlike(any_of([]))).first()[0] is False


def test_rollup_conflicts_and_chronic_exception(spark):
    rows = [(1, "problem", "HTN", 0, 3, "historical"), (1, "problem", "htn", 9, 12, "present"), (1, "problem", "pneumonia", 20, 29, "present"), (1, "problem", "pneumonia", 40, 49, "absent"), (2, "risk", "SI", 0, 2, "unknown")]
    m = spark.createDataFrame(rows, "note_id bigint, entity_type string, text string, start_char int, end_char int, assertion string").withColumn("normalized_text", F.lit(None).cast("string"))
    got = {(r["note_id"], r["canonical_text"]): (r["assertion"], r["review_priority"], r["mention_count"]) for r in R.rollup(m).collect()}
    assert got == {(1, "htn"): ("present", "routine", 2), (1, "pneumonia"): ("conflicting", "high", 2), (2, "si"): ("unknown", "high", 1)}


def test_metrics_follow_the_worked_example(spark):
    kind = "source_id string, idx bigint, entity_type string, text string, start_char int, end_char int"
    gold = spark.createDataFrame([("a", 0, "symptom", "low back pain", 0, 13), ("a", 1, "problem", "HTN", 20, 23)], kind)
    pred = spark.createDataFrame([("a", 0, "symptom", "back pain", 4, 13), ("a", 1, "problem", "HTN", 20, 23), ("a", 2, "problem", "DM", 30, 32)], kind)
    exact = E.metrics(pred, gold, E.greedy_matches(E.candidate_pairs(pred, gold, 1.0, exact_only=True))).first()
    assert (exact["true_positive"], exact["false_positive"], exact["false_negative"]) == (1, 2, 1)
    partial = E.metrics(pred, gold, E.greedy_matches(E.candidate_pairs(pred, gold, 0.3))).first()
    assert partial["true_positive"] == 2
    assert E.candidate_pairs(pred, gold, 0.5, strategy="token-jaccard").where("entity_type = 'symptom'").count() == 1


def test_greedy_takes_best_pairs_in_order(spark):
    pairs = spark.createDataFrame([("a", "x", 0, 0, 0.8, False), ("a", "x", 0, 1, 0.9, False), ("a", "x", 1, 1, 0.9, False), ("a", "x", 1, 0, 0.6, False)], "source_id string, entity_type string, p_idx bigint, g_idx bigint, score double, exact boolean")
    assert sorted((r["p_idx"], r["g_idx"]) for r in E.greedy_matches(pairs).collect()) == [(0, 1), (1, 0)]


def test_scores_of_the_worked_example(spark):
    s = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.4), (2, 1, 0.35), (3, 1, 0.9)], "ord int, y_true int, y_score double")
    assert E.roc_auc(s).first()["roc_auc"] == 0.75
    assert E.average_precision(s).first()["average_precision"] > 0.7
    one = s.where("y_true = 1")
    assert E.roc_auc(one).first()["roc_auc"] is None


def test_features_are_leakage_safe(spark):
    kind = "patient_id string, observed_at timestamp, ord int, entity_type string, normalized_text string, text string, assertion string, attributes map<string,string>"
    rows = [("p1", "2025-01-01 00:00:00", 0, "severity", "pain rating", "pain 6/10", "present", {"value": "6"}), ("p1", "2025-02-01 00:00:00", 1, "severity", "pain rating", "pain 9/10", "present", {"value": "9"}), ("p2", "2025-01-01 00:00:00", 2, "risk", "suicidal ideation", "SI", "absent", {})]
    r = spark.createDataFrame([], kind).sparkSession.createDataFrame([(a, __import__("datetime").datetime.fromisoformat(b), *x) for a, b, *x in rows], kind)
    i = spark.createDataFrame([(p, 1, __import__("datetime").datetime(2025, 2, 1)) for p in ("p1", "p2", "p3")], "patient_id string, visit_id int, prediction_time timestamp")
    got = {x["patient_id"]: x for x in X.feature_matrix(r, i).collect()}
    assert got["p1"]["pain_rating__last"] == 6.0 and not got["p1"]["pain_rating__missing"]
    assert got["p2"]["suicidal_ideation__explicitly_negated"] and got["p3"]["pain_rating__missing"]


def test_triage_reasons(spark):
    notes = spark.createDataFrame([(1, "Smothered in work. HR 72."), (2, "Mother had HR 80."), (3, "Nothing."), (4, " ")], "note_id bigint, text string")
    got = {r["note_id"]: r["reasons"] for r in triage(notes, extract_mentions(notes)).collect()}
    assert got == {1: [], 2: ["ambiguous_or_reasoning_context"], 3: ["no_deterministic_mentions"], 4: []}


def test_span_scores(spark):
    df = spark.createDataFrame([(0, 10, 5, 15), (0, 5, 5, 9)], "a int, b int, c int, d int")
    assert [round(r[0], 4) for r in df.select(char_jaccard(*[F.col(x) for x in "abcd"])).collect()] == [0.3333, 0.0]
    t = spark.createDataFrame([("low back pain", "back pain"), ("", "--"), ("a", "")], "a string, b string")
    assert [round(r[0], 4) for r in t.select(token_jaccard(F.col("a"), F.col("b"))).collect()] == [0.6667, 1.0, 0.0]


def test_strength_grades(spark):
    df = spark.createDataFrame([("4-/5",), ("4+ /5",), ("3",), ("5+",), ("x",), (None,)], "g string")
    assert [None if r[0] is None else round(r[0], 1) for r in df.select(strength_grade(F.col("g"))).collect()] == [3.7, 4.3, 3.0, None, None, None]


def test_metric_rows_by_the_first_count_then_key(spark):
    rows = spark.createDataFrame([("b", 2, None), ("a", None, 2), ("c", 5, 1), ("d", None, None)], "key string, found_count int, candidate_count int")
    got = E.in_order(rows, counts=("found_count", "candidate_count")).orderBy("place").collect()
    assert [(r["place"], r["key"]) for r in got] == [(1, "c"), (2, "a"), (3, "b"), (4, "d")]


def test_a_classifier_report_needs_whole_lists_of_0_and_1(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "ord int, y_true int, y_score double")
    both = E.classifier_report(frame((1, 1, 0.9), (2, 0, 0.1), (3, 1, 0.8))).first().asDict()
    assert both == {"sample_count": 3, "positive_count": 2, "negative_count": 1, "roc_auc": 1.0, "average_precision": 1.0}
    assert E.classifier_report(frame((1, 0, 0.9))).first().asDict() == {"sample_count": 1, "positive_count": 0, "negative_count": 1, "roc_auc": None, "average_precision": None}
    for bad, said in (((1, 2, 0.5), "0 or 1"), ((1, None, 0.5), "lacks"), ((1, 1, None), "lacks")):
        with pytest.raises(Exception, match=said):
            E.classifier_report(frame(bad)).collect()
