"""Queries over the adapters: token spans, model batches, plausibility, relations by name, code search, risk input."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import lexicon as L
from chartloom.operators import adapters as A
from chartloom.operators import rollup as R
from chartloom.operators.vocabulary import dictionary_mentions
from chartloom.plans import wide
from chartloom.plans.catalog import _RISK, BASE, _mentions, query
from chartloom.sources.wide_notes import wide_notes


@query("src_token_spans", "SELECT note_id, text, start_char, end_char, entity_type, CASE WHEN start_char % 2 = 0 THEN 1.0 ELSE 0.5 END AS confidence_score FROM gold")
def _(spark, sf):
    m = _mentions(spark, sf)
    score = F.when(F.col("start_char") % 2 == 1, F.lit(0.5))
    return A.from_token_spans(m.select("note_id", F.col("text").alias("word"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.col("entity_type").alias("entity_group"), score.alias("score")))


@query(
    "src_llm_batches",
    """, n AS (SELECT note_id, count(*) AS n, count(*) FILTER (entity_type = 'score') AS scores FROM gold GROUP BY 1)
    SELECT note_id, CASE WHEN note_id % 4 = 3 THEN NULL ELSE CAST(n AS INT) END AS n, CASE WHEN note_id % 4 = 3 THEN 'invalid-json' WHEN note_id % 4 = 2 THEN 'invalid-mention' WHEN note_id % 40 > 27 AND scores > 0 THEN 'implausible-value' END AS error FROM n""",
)
def _(spark, sf):
    """Answers of a model: arrays, objects, answers with a span of no length, and broken ones; scores are set to note_id % 40."""
    kind = F.col("note_id") % 4
    value = F.when(F.col("entity_type") == "score", F.map_concat(F.map_filter("attributes", lambda k, v: k != "value"), F.create_map(F.lit("value"), (F.col("note_id") % 40).cast("string")))).otherwise(F.col("attributes"))
    m = F.struct("text", "entity_type", "start_char", F.when(kind == 2, F.col("start_char")).otherwise(F.col("end_char")).alias("end_char"), "assertion", "confidence_score", "normalized_text", value.alias("attributes"))
    body = F.to_json(F.collect_list(m))
    raw = _mentions(spark, sf).groupBy("note_id").agg(body.alias("b")).select("note_id", F.when(F.col("note_id") % 4 == 1, F.concat(F.lit('{"mentions":'), F.col("b"), F.lit("}"))).when(F.col("note_id") % 4 == 3, F.lit("{not json")).otherwise(F.col("b")).alias("raw"))
    return A.parse_batches(raw).select("note_id", F.when(F.col("mentions").isNotNull(), F.size("mentions")).alias("n"), "error")


_SESSIONS = """, e AS (SELECT note_id // 12 AS session_id, entity_type, canonical_name, min(note_id * 1000 + start_char) AS ord FROM dic GROUP BY ALL)
SELECT s.session_id, s.ord AS source, r.relation, t.ord AS target FROM e s JOIN (VALUES ('lisinopril', 'treats', 'hypertension'), ('albuterol', 'treats', 'asthma')) r(s_name, relation, t_name) ON s.canonical_name = r.s_name AND s.entity_type = 'medication'
JOIN e t ON t.session_id = s.session_id AND t.canonical_name = r.t_name"""


@query("rel_named", _SESSIONS, wide.BASE)
def _(spark, sf):
    m = dictionary_mentions(wide_notes(spark, sf))
    e = m.groupBy(F.expr("note_id div 12").alias("session_id"), "entity_type", "canonical_name").agg(F.min(F.col("note_id") * 1000 + F.col("start_char")).alias("ord"))
    return A.named_relations(e)


_SHOWN = " UNION ALL ".join(f"SELECT '{n}' AS name, '{c}' AS code, '{d}' AS display" for n, _, _, c, d, _ in L.STARTER_CODES)


@query("trm_search", f"WITH c AS ({_SHOWN}), q AS (SELECT event_id AS query_id, CASE event_id % 3 WHEN 0 THEN 'PRESSURE' WHEN 1 THEN 'rat' ELSE '4' END AS f FROM events), r AS (SELECT query_id, name, code, display, row_number() OVER (PARTITION BY query_id ORDER BY name, code) AS rank FROM q JOIN c ON contains(lower(name || ' ' || code || ' ' || display), lower(f))) SELECT query_id, CAST(rank AS INT) AS rank, name, code, display FROM r WHERE rank <= 2", "")
def _(spark, sf):
    q = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("query_id"), F.when(F.col("event_id") % 3 == 0, "PRESSURE").when(F.col("event_id") % 3 == 1, "rat").otherwise("4").alias("filter"))
    return A.search_codes(R.starter_codes(spark), q, 2)


@query(
    "rsk_resolved",
    "SELECT note_id, CASE WHEN heart_rate__missing = 1 THEN 0 ELSE heart_rate__mean END AS heart_rate__mean, CASE WHEN bp_missing = 1 THEN NULL ELSE bp_systolic__last END AS bp_systolic__last, concat_ws(',', CASE WHEN pain_rating__missing = 0 THEN 'pain_rating__missing' END, CASE WHEN heart_rate__missing = 1 THEN 'heart_rate__mean' END) AS coerced, CASE WHEN bp_missing = 1 THEN 'bp_systolic__last' ELSE '' END AS missing_required FROM rf",
    BASE + _RISK,
)
def _(spark, sf):
    """Features with gaps: absent values are null, and the pain indicator is only given where it is 1."""
    from chartloom.operators.features import risk_features

    f = risk_features(_mentions(spark, sf))
    f = f.withColumn("heart_rate__mean", F.when(F.col("heart_rate__missing") == 0, F.col("heart_rate__mean"))).withColumn("bp_systolic__last", F.when(F.col("bp_missing") == 0, F.col("bp_systolic__last"))).withColumn("pain_rating__missing", F.when(F.col("pain_rating__missing") == 1, F.lit(1.0)))
    out = A.resolved_risk_input(f)
    return out.select("note_id", "heart_rate__mean", "bp_systolic__last", F.array_join("coerced", ",").alias("coerced"), F.array_join("missing_required", ",").alias("missing_required"))
