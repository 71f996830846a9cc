"""Queries over whole documents: context, envelope, client entities, resources, reports, uncertainty, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions.lexicon import PSYCH_CONTEXT, STARTER_CODES
from chartloom.operators import documents as D
from chartloom.operators import rollup as R
from chartloom.operators.context import LEXICAL, note_abbreviations, note_context
from chartloom.plans.catalog import _ENTITIES, BASE, _mentions, query
from chartloom.sources.notes import clinical_notes, literal
from chartloom.streaming.mentions import answers, refused, session_table

_SCORES = ", ".join(
    f"CAST({' + '.join(f'CASE WHEN regexp_matches(text, {literal(p)}) THEN {w} ELSE 0 END' for p, s, w in LEXICAL if s == own)} + {extra} AS INT) AS {name}"
    for own, name, extra in (
        ("primary-care", "pc", "CASE WHEN template_id = 20 THEN 1 ELSE 0 END"),
        ("mental-health", "mh", "CASE WHEN template_id = 15 THEN 2 ELSE 0 END"),
        ("physical-therapy", "pt", "CASE WHEN template_id = 21 THEN 2 ELSE 0 END"),
    )
)
_CONTEXT = f""", sc AS (SELECT note_id, template_id, text, {_SCORES} FROM notes), ranked AS (SELECT *, list_sort([pc, mh, pt], 'DESC') AS r FROM sc),
ctx AS (SELECT *, CASE WHEN r[1] = 0 THEN 'mixed' WHEN r[2] > 0 AND r[1] - r[2] <= 1 THEN 'mixed' WHEN pc = r[1] THEN 'primary-care' WHEN mh = r[1] THEN 'mental-health' ELSE 'physical-therapy' END AS primary_specialty,
 CASE WHEN template_id IN (15, 20, 21) THEN 'soap' WHEN template_id = 14 THEN 'progress-note' ELSE 'unknown' END AS note_type FROM ranked)"""


@query("ctx_scores", "SELECT note_id, note_type, pc, mh, pt, primary_specialty FROM ctx", BASE + _CONTEXT)
def _(spark, sf):
    return note_context(clinical_notes(spark, sf)).select("note_id", "note_type", "pc", "mh", "pt", "primary_specialty")


@query(
    "abr_resolutions",
    r""", si AS (SELECT note_id, len(regexp_extract_all(text, '(?i)\bSI\b')) AS n, primary_specialty AS p, (SELECT count(*) FROM (VALUES ('hi'), ('phq-9'), ('risk'), ('denies')) AS h(w) WHERE contains(lower(text), w)) AS hints FROM ctx)
    SELECT note_id, 'SI' AS abbreviation, CAST(n AS INT) AS n, CASE WHEN ok THEN 'suicidal ideation' ELSE 'stroke index' END AS meaning, CASE WHEN ok THEN 'suicidal ideation' END AS canonical_name
    FROM (SELECT *, hints + CASE WHEN p IN ('mental-health', 'mixed') THEN 1 ELSE 0 END >= CASE WHEN p IN ('primary-care', 'mixed') THEN 1 ELSE 0 END AS ok FROM si WHERE n > 0)
    UNION ALL SELECT note_id, 'PT', 1, 'patient', NULL FROM notes WHERE template_id = 21""",
    BASE + _CONTEXT,
)
def _(spark, sf):
    return note_abbreviations(clinical_notes(spark, sf)).drop("place")


@query("ctx_active", "SELECT note_id, concat_ws(',', 'mixed', CASE WHEN pc > 0 THEN 'primary-care' END, CASE WHEN mh > 0 THEN 'mental-health' END, CASE WHEN pt > 0 THEN 'physical-therapy' END) AS active FROM ctx", BASE + _CONTEXT)
def _(spark, sf):
    return note_context(clinical_notes(spark, sf)).select("note_id", F.array_join("active_specialties", ",").alias("active"))


@query("svc_envelope", ", n AS (SELECT note_id, count(*) AS n_mentions FROM gold GROUP BY 1), k AS (SELECT note_id, count(*) AS n_entities FROM ent GROUP BY 1) SELECT note_id, CAST(n_mentions AS INT) AS n_mentions, CAST(n_entities AS INT) AS n_entities FROM n JOIN k USING (note_id)", BASE + _ENTITIES)
def _(spark, sf):
    body = D.envelope(_mentions(spark, sf), spark)
    kind = "mentions array<struct<text:string>>, entities array<struct<canonical_text:string>>"
    return body.select("note_id", F.from_json("body", kind).alias("b")).select("note_id", F.size("b.mentions").alias("n_mentions"), F.size("b.entities").alias("n_entities"))


_BODY = rf""", conf AS (SELECT g.*, row_number() OVER (PARTITION BY g.note_id ORDER BY g.start_char, g.end_char, g.entity_type) - 1 AS idx, g.text = 'SI' AND NOT regexp_matches(n.text, {literal(PSYCH_CONTEXT)}) AS bare FROM gold g JOIN notes n USING (note_id)),
said AS (SELECT note_id, '[' || string_agg('{{"text":"' || text || '","entity_type":"' || entity_type || '","start_char":' || CAST(start_char AS STRING) || ',"end_char":' || CAST(end_char AS STRING) || ',"assertion":"' || assertion || '","confidence_score":'
  || CASE WHEN bare THEN '0.4' WHEN entity_type = 'risk' THEN '0.86' ELSE '0.92' END || ',"normalized_text":"' || normalized_text || '","section_context":' || CASE entity_type WHEN 'vital' THEN '"vitals"' ELSE 'null' END || ',"attributes":{{'
  || CASE canonical_text WHEN 'heart rate' THEN '"measurement":"heart-rate","unit":"beats/min","value":"' || regexp_extract(text, '(\d+)$', 1) || '"' WHEN 'blood pressure' THEN '"measurement":"blood-pressure","unit":"mmHg","systolic":"' || regexp_extract(text, '(\d+)/', 1) || '","diastolic":"' || regexp_extract(text, '/(\d+)', 1) || '"'
     WHEN 'phq-9' THEN '"scale":"PHQ-9","value":"' || regexp_extract(text, '(\d+)$', 1) || '"' WHEN 'pain rating' THEN '"scale":"0-10","value":"' || regexp_extract(text, '(\d+)/10', 1) || '"' ELSE CASE WHEN bare THEN '"review_reason":"ambiguous-SI-no-psych-context"' ELSE '' END END || '}}}}', ',' ORDER BY idx) || ']' AS mentions FROM conf GROUP BY note_id),
places AS (SELECT note_id, entity_type, canonical_text, string_agg(CAST(idx AS STRING), ',' ORDER BY idx) AS spots FROM conf GROUP BY ALL),
told AS (SELECT e.note_id, '[' || string_agg('{{"entity_type":"' || entity_type || '","canonical_text":"' || canonical_text || '","assertion":"' || assertion || '","review_priority":"' || CASE WHEN assertion IN ('conflicting', 'unknown') THEN 'high' ELSE 'routine' END || '","mention_indexes":[' || spots || '],"codings":['
  || coalesce('{{"system":"' || c.system || '","code":"' || c.code || '","display":"' || c.display || '","release_version":null,"confidence":' || c.confidence || '}}', '') || '],"is_coded":false}}', ',' ORDER BY first_start, entity_type, canonical_text) || ']' AS entities
  FROM ent e JOIN places USING (note_id, entity_type, canonical_text) LEFT JOIN ({" UNION ALL ".join(f"SELECT {literal(n)} AS name, {literal(t)} AS t, {literal(s)} AS system, {literal(c)} AS code, {literal(d)} AS display, {literal(str(k))} AS confidence" for n, t, s, c, d, k in STARTER_CODES)}) c ON c.name = canonical_text AND c.t = entity_type GROUP BY e.note_id)"""


@query("svc_envelope_json", """SELECT note_id, '{"mentions":' || mentions || ',"entities":' || entities || '}' AS body FROM said JOIN told USING (note_id)""", BASE + _ENTITIES + _BODY)
def _(spark, sf):
    return D.envelope(_mentions(spark, sf), spark)


@query(
    "svc_client_entities",
    f""", top AS (SELECT g.note_id, g.entity_type, g.canonical_text, max(CASE WHEN g.text = 'SI' AND NOT regexp_matches(n.text, {literal(PSYCH_CONTEXT)}) THEN 0.4 WHEN g.entity_type = 'risk' THEN 0.86 ELSE 0.92 END) AS c FROM gold g JOIN notes n USING (note_id) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY first_start, entity_type, canonical_text) - 1 AS ord FROM ent JOIN top USING (note_id, entity_type, canonical_text))
    SELECT note_id, entity_type || '-' || trim(regexp_replace(canonical_text, '[^a-z0-9]+', '-', 'g'), '-') || '-' || CAST(ord AS STRING) AS id, entity_type, assertion,
    CASE WHEN assertion IN ('conflicting', 'unknown') THEN 'high' ELSE 'needs-review' END AS priority, CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM o""",
    BASE + _ENTITIES,
)
def _(spark, sf):
    return D.client_entities(_mentions(spark, sf), spark).select("note_id", "id", "entity_type", "assertion", "priority", "confidence")


@query("fhir_resources", "SELECT note_id, start_char, CASE WHEN entity_type IN ('vital', 'score', 'severity') THEN 'Observation' ELSE 'Condition' END AS resource_type FROM gold")
def _(spark, sf):
    m = _mentions(spark, sf)
    return m.select("note_id", "start_char", D.resource_type(F.col("entity_type"), F.col("assertion")).alias("resource_type"))


@query("fhir_bundles", "SELECT note_id, count(*) AS n, '' AS errors, string_agg(DISTINCT CASE WHEN entity_type = 'risk' THEN 'Condition' ELSE 'Observation' END, ',' ORDER BY CASE WHEN entity_type = 'risk' THEN 'Condition' ELSE 'Observation' END) AS types FROM gold GROUP BY note_id")
def _(spark, sf):
    made = D.bundles(D.resources(_mentions(spark, sf)))
    return D.bundle_problems(made).select("note_id", F.col("n_entries").cast("bigint").alias("n"), "errors", "types")


@query(
    "fhir_blood_pressure",
    r"""SELECT note_id, start_char, CAST(regexp_extract(text, '(\d+)/', 1) AS DOUBLE) AS systolic, CAST(regexp_extract(text, '/(\d+)', 1) AS DOUBLE) AS diastolic FROM gold WHERE canonical_text = 'blood pressure'""",
)
def _(spark, sf):
    m = _mentions(spark, sf).where("normalized_text = 'blood pressure'")
    r = D.resources(m).join(m.select("note_id", F.col("mention_idx").alias("ord"), "start_char"), ["note_id", "ord"])
    b = r.select("note_id", "start_char", F.from_json("body", "component array<struct<code:string, valueQuantity:struct<value:double>>>").alias("b"))
    return b.select("note_id", "start_char", F.col("b.component")[0]["valueQuantity"]["value"].alias("systolic"), F.col("b.component")[1]["valueQuantity"]["value"].alias("diastolic"))


@query(
    "src_report",
    """SELECT note_id, '# Entities' || chr(10) || string_agg('- ' || list_aggregate(list_transform(string_split(canonical_text, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' (' || entity_type || ', ' || assertion || ', ' || CASE WHEN assertion IN ('conflicting', 'unknown') THEN 'high' ELSE 'routine' END || ')', chr(10) ORDER BY first_start, entity_type) AS report FROM ent GROUP BY note_id""",
    BASE + _ENTITIES,
)
def _(spark, sf):
    return D.reports(R.rollup(_mentions(spark, sf)))


@query(
    "unc_priorities",
    """, u AS (SELECT note_id, entity_type, canonical_text, assertion, CASE WHEN assertion = 'conflicting' THEN 1 ELSE 0 END + CASE WHEN entity_type = 'risk' AND note_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN note_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN entity_type = 'score' THEN 1 ELSE 0 END AS n, entity_type = 'risk' AND note_id % 3 = 0 AS low FROM ent)
    SELECT note_id, entity_type, canonical_text, CAST(n AS INT) AS n_reasons, CASE WHEN assertion = 'conflicting' THEN 'high' WHEN n = 0 THEN 'routine' WHEN low OR n >= 2 THEN 'high' ELSE 'needs-review' END AS priority FROM u""",
    BASE + _ENTITIES,
)
def _(spark, sf):
    even = F.col("note_id") % 2 == 0
    e = R.rollup(_mentions(spark, sf)).select(
        "note_id", "entity_type", "canonical_text", "assertion", F.when((F.col("entity_type") == "risk") & (F.col("note_id") % 3 == 0), "low").otherwise("high").alias("confidence"), F.when(even, 0).otherwise(1).alias("n_codings"),
        F.lit(False).alias("low_coding"), F.lit(0).alias("n_relations"), F.array(F.lit("text")).alias("texts"), F.array(F.lit("plan")).alias("sections"),
    )
    return D.uncertainty(e).select("note_id", "entity_type", "canonical_text", F.size("uncertainty_reasons").alias("n_reasons"), "priority")


def _requests(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    op = F.when(F.col("event_id") % 5 == 0, "ping").when(F.col("event_id") % 5 == 1, "delete").otherwise("extract")
    text = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.repeat(F.lit("a"), 100001)).otherwise(F.concat(F.lit("HR "), (F.col("event_id") % 40 + 60).cast("string")))
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), op.alias("op"), text.alias("text"))


@query("svc_errors", "WITH x AS (SELECT event_id, event_id % 5 AS o FROM events) SELECT CAST(event_id AS STRING) AS id, CASE WHEN o = 1 THEN 'unknown-op' WHEN o > 1 AND event_id % 7 = 0 THEN 'invalid-text' WHEN o > 1 AND event_id % 11 = 0 THEN 'note-too-large' END AS error FROM x WHERE o = 1 OR (o > 1 AND (event_id % 7 = 0 OR event_id % 11 = 0))", "")
def _(spark, sf):
    return refused(_requests(spark, sf))


@query("str_sessions", "SELECT CAST(user_id AS STRING) AS session_id, max(event_id) AS seq, count(*) AS n_requests FROM events WHERE event_id % 7 <> 0 GROUP BY 1", "")
def _(spark, sf):
    return session_table(_requests(spark, sf)).select("session_id", "seq", "n_requests")


@query(
    "svc_answers",
    """WITH x AS (SELECT event_id, event_id % 5 AS o FROM events), y AS (SELECT *, CASE WHEN o = 1 THEN 'unknown-op' WHEN o > 1 AND event_id % 7 = 0 THEN 'invalid-text' WHEN o > 1 AND event_id % 11 = 0 THEN 'note-too-large' END AS code FROM x)
    SELECT CAST(event_id AS STRING) AS id, code IS NULL AS ok, code, CASE WHEN code IS NULL AND o > 1 THEN 1 END AS n_mentions FROM y""",
    "",
)
def _(spark, sf):
    rows = answers(_requests(spark, sf))
    b = F.from_json("body", "error struct<code:string>, result struct<mentions:array<struct<text:string>>>")
    return rows.select("id", "ok", b["error"]["code"].alias("code"), F.when(b["result"].isNotNull(), F.size(b["result"]["mentions"])).alias("n_mentions"))
