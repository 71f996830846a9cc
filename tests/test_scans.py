"""Scans of notes: once a note, after the notes are dealt, and grouped where they are."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from chartloom.functions import spans
from chartloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def optimized(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["gate_documents", "svc_client_entities"])
def test_a_note_is_grouped_where_it_was_dealt(spark, name):
    """one shuffle, by note, whose number of tasks follows the notes; mentions are found in one place."""
    made = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert made.count("Exchange hashpartitioning(event_id") == 1 and "RoundRobin" not in made and "hashpartitioning(note_id" not in made
    assert made.count("FileScan") == 1


def test_nothing_is_searched_before_notes_are_dealt(spark):
    """F16: a filter on what explode is given would be a second search, on the few partitions that are read."""
    made = optimized(spark, "abr_resolutions")
    assert "RepartitionByExpression" in made and "Filter" not in made.split("RepartitionByExpression")[1]


def test_a_note_is_lowered_once_for_all_families(spark):
    """F13, F19."""
    for name in ("reg_families", "reg_families_by_specialty"):
        assert "Contains(lower(" not in optimized(spark, name)


def test_headings_are_searched_once(spark):
    """F8, F23: a note's sections are found in one search for headings."""
    from chartloom.operators.sections import sections

    made = spark.read.parquet(f"{SF}/documents.parquet").select(sections(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("regexp_extract_all") <= 6


@pytest.mark.parametrize("name", ["ext_hybrid", "rsk_training_report"])
def test_what_is_read_again_is_written_once(spark, name):
    """the result is made from written mentions (cases), not from notes searched anew."""
    assert "chief complaint" not in optimized(spark, name) and "heart rate)" not in optimized(spark, name)


def test_pieces_are_as_split_gives_them(spark):
    texts = ["", "a", "SI", "x SI y si.", "SISI SI", "a\x01SI\x01b", "SI SI", "no. SI, but\x01", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    p, t = r"(?i)(?<![A-Za-z0-9])SI(?![A-Za-z0-9])|but", F.col("t")
    for r in rows.select(
        spans.pieces(t, p).alias("a"), F.split(t, p, -1).alias("b"), spans.before_first(t, p).alias("c"), F.element_at(F.split(t, p, 2), 1).alias("d"), spans.behind_last(t, p).alias("e"), F.element_at(F.split(t, p, -1), -1).alias("f")
    ).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"] and r["e"] == r["f"]


def test_a_worker_remembers_no_more_than_it_is_told():
    """pipeline: what is forgotten is encoded anew, with the same ids."""
    import public_tokenizers

    from chartloom.llm.bpe import ForcedBoundaryBPE

    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(f"word{k} other{k % 7}" for k in range(200)).encode()
    few, many = ForcedBoundaryBPE(path, 10), ForcedBoundaryBPE(path)
    assert few.encode(text) == many.encode(text)
    assert len(few.pieces) <= 10 and len(few.fragments) <= 10 < len(many.pieces)
