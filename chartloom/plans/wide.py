"""Queries over the wide view: pattern families, dictionary, merged entities, nearest targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import vocabulary as W
from chartloom.plans.catalog import query
from chartloom.sources.wide_notes import dictionary_truth_sql, family_truth_sql, wide_notes, wide_sql

BASE = f"WITH wide AS ({wide_sql()}), fam AS ({family_truth_sql()}), dic AS ({dictionary_truth_sql()})"


@query("reg_families", "SELECT * FROM fam", BASE)
def _(spark, sf):
    return W.family_mentions(wide_notes(spark, sf)).select("note_id", "entity_type", "canonical_name", "text", "start_char", "value", "unit", "assertion", "detail")


@query("reg_families_by_specialty", "SELECT entity_type, count(*) AS n FROM fam WHERE NOT (canonical_name IN ('manual muscle test', 'treatment frequency')) GROUP BY ALL", BASE)
def _(spark, sf):
    found = W.family_mentions(wide_notes(spark, sf), active=("primary-care",))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"))


@query("dic_concepts", "SELECT * FROM dic", BASE)
def _(spark, sf):
    return W.dictionary_mentions(wide_notes(spark, sf)).select("note_id", "entity_type", "canonical_name", "text", "start_char", "confidence", "assertion", "temporality", "laterality")


@query(
    "dic_entities",
    """, r AS (SELECT *, length(text) AS n FROM dic), kept AS (SELECT a.* FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.note_id = a.note_id AND b.canonical_name = a.canonical_name AND b.start_char < a.start_char AND a.start_char < b.start_char + b.n))
    SELECT note_id, entity_type, lower(canonical_name) AS canonical_name, min(assertion) AS assertion, CAST(count(*) AS INT) AS mention_count, min(start_char) AS first_start FROM kept GROUP BY ALL""",
    BASE,
)
def _(spark, sf):
    return W.merged_entities(W.dictionary_mentions(wide_notes(spark, sf))).drop("first_text")


@query("dic_assertion_counts", "SELECT entity_type, assertion, count(*) AS n FROM dic GROUP BY ALL", BASE)
def _(spark, sf):
    return W.dictionary_mentions(wide_notes(spark, sf)).groupBy("entity_type", "assertion").agg(F.count("*").alias("n"))


_ORD = """, r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY start_char, text) AS ord FROM dic),
  pairs AS (SELECT s.note_id, s.ord AS source, t.ord AS target, abs(s.start_char - t.start_char) AS distance FROM r s JOIN r t ON s.note_id = t.note_id WHERE s.entity_type IN ('symptom', 'lab', 'plan') AND t.entity_type = 'problem' AND abs(s.start_char - t.start_char) <= 180 AND s.ord <> t.ord)"""


@query("rel_nearest", "SELECT note_id, CAST(source AS INT) AS source, CAST(target AS INT) AS target, CAST(distance AS INT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY note_id, source ORDER BY distance, target) AS k FROM pairs) WHERE k = 1", BASE + _ORD)
def _(spark, sf):
    from pyspark.sql.window import Window

    rows = W.dictionary_mentions(wide_notes(spark, sf)).withColumn("ord", F.row_number().over(Window.partitionBy("note_id").orderBy("start_char", "text")))
    return W.nearest(rows.where(F.col("entity_type").isin("symptom", "lab", "plan")), rows.where("entity_type = 'problem'"))


@query("set_union_scans", "SELECT note_id, canonical_name, start_char FROM fam UNION SELECT note_id, canonical_name, start_char FROM dic", BASE)
def _(spark, sf):
    notes = wide_notes(spark, sf)
    a, b = (d.select("note_id", "canonical_name", "start_char") for d in (W.family_mentions(notes), W.dictionary_mentions(notes)))
    return a.union(b).distinct()


def _by_scans(spark, sf):
    """(note_id, canonical_name, dictionary, families): the names of a note, and which scans found them; both sides are grouped at once
    and never joined."""
    notes = wide_notes(spark, sf)
    own = lambda d, dictionary: d.select("note_id", "canonical_name", F.lit(dictionary).alias("own"))
    rows = own(W.dictionary_mentions(notes), True).union(own(W.family_mentions(notes), False))
    return rows.groupBy("note_id", "canonical_name").agg(F.bool_or("own").alias("dictionary"), F.bool_or(~F.col("own")).alias("families"))


@query("set_missed_by_families", "SELECT note_id, canonical_name FROM dic EXCEPT SELECT note_id, canonical_name FROM fam", BASE)
def _(spark, sf):
    return _by_scans(spark, sf).where("dictionary AND NOT families").select("note_id", "canonical_name")


@query("set_found_by_both", "SELECT note_id, canonical_name FROM dic INTERSECT SELECT note_id, canonical_name FROM fam", BASE)
def _(spark, sf):
    return _by_scans(spark, sf).where("dictionary AND families").select("note_id", "canonical_name")
