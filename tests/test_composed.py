"""The composed extraction: entities of a note are linked where the note was dealt, by the rules of the joins."""

import random
import re

from pyspark.sql import functions as F

from chartloom.operators import relations as N
from chartloom.operators.composed import documents
from chartloom.sources.wide_notes import wide_notes

SF = "/root/testdata/sf0.001"
NAMES = (
    ("metformin", "medication"), ("type 2 diabetes mellitus", "problem"), ("hemoglobin a1c", "lab"), ("lumbar mri", "imaging"), ("shoulder x-ray", "imaging"), ("low back pain", "problem"), ("low back pain", "symptom"), ("shoulder pain", "symptom"),
    ("follow up", "plan"), ("referral to psychiatry", "referral"), ("safety plan", "other"), ("suicidal ideation", "risk"),
)


def test_no_table_is_written_and_only_notes_are_shuffled(spark):
    """mentions and entities are not written for a second reading, nor shuffled, since notes are dealt by their key."""
    df = documents(wide_notes(spark, SF))
    assert df.collect()
    made = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Final Plan" in made and "ExistingRDD" not in made
    keys = {re.search(r"hashpartitioning\((\w+?)#", x)[1] for x in made.splitlines() if "Exchange hashpartitioning" in x}
    assert "event_id" in keys and "note_id" not in keys


def test_rules_over_arrays_are_those_of_the_joins(spark):
    rnd, rows = random.Random(3), []
    for note in range(60):
        for ord_, (name, kind) in enumerate(rnd.sample(NAMES, rnd.randint(1, len(NAMES))), 1):
            starts = sorted(rnd.sample(range(0, 700, 5), rnd.randint(1, 3)))
            spans = [(s, s + rnd.choice((4, 9, 200))) for s in starts]
            rows.append((note, ord_, kind, name, rnd.choice(("present", "absent", "ordered", None)), rnd.choice(("low", "medium", "high")), spans, rnd.sample(["PT", "cp", "SI", "x"], 2), starts[0]))
    kind = "note_id int, ord int, entity_type string, canonical_name string, assertion string, confidence string, spans array<struct<start_char:int,end_char:int>>, texts array<string>, first_start int"
    entities = spark.createDataFrame(rows, kind).cache()
    answers = [(n, p, a, m, low, c) for n in range(60) for p, (a, m, c, low) in enumerate(rnd.sample([("PT", None, None, True), ("CP", "chest pain", "low back pain", False), ("SI", "stroke index", None, True), ("CA", "x", "shoulder pain", True)], n % 5))]
    resolved = spark.createDataFrame(answers, "note_id int, place int, abbreviation string, meaning string, low boolean, canonical_name string").cache()

    rank = F.coalesce(*[F.when(F.col("confidence") == w, n) for w, n in N.CONFIDENCE_RANK.items()])
    one = F.struct("ord", "entity_type", "canonical_name", "assertion", rank.alias("rank"), "spans", "texts", "first_start", "rules")
    listed = entities.join(N.rules_by_source(spark), F.col("canonical_name") == F.col("source_name"), "left").groupBy("note_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    answer = F.struct("place", "abbreviation", "meaning", "low", "canonical_name")
    listed = listed.join(resolved.groupBy("note_id").agg(F.collect_list(answer).alias("answers")), "note_id", "left")
    each = F.transform("all", lambda e: F.struct(e["ord"].alias("ord"), N.is_nested_symptom(e, N.problem_spans(F.col("all"))).alias("nested"), N.n_links(e, F.col("all")).alias("n"), N.fitting_resolution(e, F.col("answers"))["abbreviation"].alias("a")))
    got = {(r["note_id"], r["ord"]): (r["nested"], r["n"], r["a"]) for r in listed.select("note_id", F.explode(each).alias("e")).select("note_id", "e.*").collect()}

    kept = {(r["note_id"], r["ord"]) for r in N.without_nested_symptoms(entities.withColumn("mentions", F.col("spans"))).collect()}
    links = entities.select("note_id", "ord", "entity_type", "canonical_name", "assertion", F.lit(None).cast("string").alias("body_site"), F.col("first_start").alias("start_char"), F.col("spans.start_char").alias("starts"), F.array().cast("array<string>").alias("sentences"))
    n = {(r["note_id"], r["source"]): r["n"] for r in N.relations(links).groupBy("note_id", "source").agg(F.count("*").alias("n")).collect()}
    told = {(r["note_id"], r["ord"]): r["abbreviation"] for r in N.with_disambiguation(entities, resolved).collect()}
    assert got == {k: (k not in kept, n.get(k, 0), told[k]) for k in told}
    assert len({x for x in got.values()}) > 6 and any(x[0] for x in got.values())
