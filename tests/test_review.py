"""Edge cases of terminology, export, sessions, relations, the cascade and exchange resources."""

import json

import pytest
from pyspark.sql import functions as F

from chartloom.operators import evaluation as E
from chartloom.operators import export as G
from chartloom.operators import features as X
from chartloom.operators import fhir as R
from chartloom.operators import hybrid as H
from chartloom.operators import sessions as S
from chartloom.operators import terminology as T
from chartloom.operators.adapters import from_labelled_spans, search_codes
from chartloom.operators.vocabulary import dictionary_mentions


def test_seed_files_and_unknown_systems(spark, tmp_path):
    path = tmp_path / "seed.json"
    path.write_text(json.dumps([{"canonical_name": "Asthma", "system": "ICD-10-CM", "code": "J45", "display": "d", "confidence": "sure", "rationale": "r"}]))
    row = T.read_seed(spark, str(path)).first()
    assert (row["canonical_name"], row["system"], row["confidence"], row["release_version"]) == ("asthma", "http://hl7.org/fhir/sid/icd-10-cm", 0.5, None)
    bad = spark.createDataFrame([("x", "OWN", "1", "d", None, "low")], T._SEED)
    with pytest.raises(Exception, match="unknown code system"):
        T.seed(bad).collect()


def test_modes_and_settings(tmp_path):
    with pytest.raises(ValueError, match="needs a client"):
        H.extractor("hybrid")
    with pytest.raises(ValueError, match="one of"):
        H.extractor("other")
    path = tmp_path / "c.json"
    path.write_text('{"mode": "llm"}')
    assert H.read_config(str(path)) == {"mode": "llm", "llm_max_retries": 2, "hybrid_max_context_chars": 2400}
    path.write_text('{"nope": 1}')
    with pytest.raises(ValueError, match="unknown"):
        H.read_config(str(path))


def test_empty_and_null_notes(spark):
    notes = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "note_id bigint, text string")
    assert dictionary_mentions(notes).count() == 0 and dictionary_mentions(notes.limit(0)).count() == 0
    assert S.validated(notes.select(F.col("note_id").alias("session_id"), F.col("text").alias("raw"))).where("ok").count() == 0
    assert [r["name"] for r in notes.select(S.session_name("text").alias("name")).collect()] == ["Untitled clinical note"] * 3


def test_any_source_matching_takes_the_best_pairs_first(spark):
    kind = "source_id string, idx bigint, entity_type string, text string, start_char int, end_char int"
    p = spark.createDataFrame([(None, 0, "v", "a b", 0, 10), ("x", 1, "v", "b", 0, 9), ("y", 0, "v", "c", 300, 304)], kind)
    g = spark.createDataFrame([("x", 0, "v", "b", 0, 9), ("x", 1, "v", "a b", 0, 10), ("z", 0, "v", "c", 300, 304)], kind)
    got = {(r["p_source"], r["p_idx"], r["g_source"], r["g_idx"]) for r in E.any_source_matches(E.any_source_pairs(p, g)).collect()}
    assert got == {(None, 0, "x", 1), ("x", 1, "x", 0)}
    tokens = {(r["p_idx"], r["g_idx"]) for r in E.any_source_pairs(p, g, strategy="token-jaccard").collect()}
    assert tokens == {(0, 0), (0, 1), (1, 0), (1, 1)}
    with pytest.raises(ValueError):
        E.any_source_pairs(p, g, threshold=0)


def test_running_sums_over_groups_and_nothing(spark):
    rows = spark.createDataFrame([("a", i, i % 3) for i in range(40)] + [("b", 5, 1), (None, 1, 1)], "g string, k int, v int")
    got = {(r["g"], r["k"]): r["s"] for r in E.running(rows, ["g"], [F.col("k").asc()], {"s": F.col("v")}).collect()}
    assert all(got["a", i] == sum(j % 3 for j in range(i + 1)) for i in range(40)) and got["b", 5] == got[None, 1] == 1
    assert E.running(rows.limit(0), ["g"], [F.col("k").asc()], {"s": F.col("v")}).count() == 0


def test_code_search_of_short_filters(spark):
    codes = spark.createDataFrame([("hypertension", "S", "I10", "Essential"), ("asthma", "S", "J45", "Asthma")], "name string, system string, code string, display string")
    q = spark.createDataFrame([(1, "J4"), (2, "TENS"), (3, ""), (4, "zz"), (5, "a")], "query_id bigint, filter string")
    got = sorted((r["query_id"], r["name"]) for r in search_codes(codes, q).collect())
    assert got == [(1, "asthma"), (2, "hypertension"), (3, "asthma"), (3, "hypertension"), (5, "asthma"), (5, "hypertension")]


def test_spans_need_a_known_label(spark):
    kind = "text string, start_char int, end_char int, label string"
    assert from_labelled_spans(spark.createDataFrame([("HR", 0, 2, "vital")], kind)).first()["entity_type"] == "vital"
    with pytest.raises(Exception, match="no entity type"):
        from_labelled_spans(spark.createDataFrame([("HR", 0, 2, "PERSON")], kind)).collect()


def test_risk_model_files(tmp_path, spark):
    path = tmp_path / "m.json"
    raw = {"featureNames": ["a"], "intercept": 0.0, "weights": {"a": 2.0}, "normalization": {"a": {"center": 1.0, "scale": 2.0}}, "thresholds": {"decision": 0.5, "low": 0.35, "high": 0.65}}
    path.write_text(json.dumps(raw))
    model = X.read_risk_model(str(path))
    row = X.risk_score(spark.createDataFrame([(3.0,)], "a double"), model).first()
    assert row["probability"] == 0.881 and row["band"] == "high"
    path.write_text(json.dumps({**raw, "normalization": {"a": {"center": 0, "scale": 0}}}))
    with pytest.raises(ValueError):
        X.read_risk_model(str(path))


def test_exports_of_nothing_and_bundles_read_back(spark):
    kind = "session_id bigint, ord int, id string, entity_type string, canonical_text string, display_name string, tier string, reason string"
    assert G.exports(spark.createDataFrame([], kind), "json").count() == 0
    bodies = spark.createDataFrame([(1, None), (2, "[]"), (3, '{"resourceType":"Bundle","type":"collection","entry":[]}')], "note_id bigint, body string")
    got = {r["note_id"]: (r["ok"], r["resource_count"]) for r in R.bundle_quality(bodies).collect()}
    assert got == {1: (False, 0), 2: (False, 0), 3: (True, 0)}
