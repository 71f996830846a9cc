"""Queries over terminology, gated export, sessions, the second look at a note, relations, the cascade and wider evaluation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chartloom.functions.terminology import SYSTEM_URIS, SYSTEMS, seed_rows
from chartloom.operators import evaluation as E
from chartloom.operators import export as G
from chartloom.operators import fhir as X
from chartloom.operators import hybrid as H
from chartloom.operators import lab as B
from chartloom.operators import relations as N
from chartloom.operators import rollup as R
from chartloom.operators import sessions as S
from chartloom.operators import terminology as T
from chartloom.operators import vocabulary as W
from chartloom.operators.documents import title_case
from chartloom.operators.extraction import extract_mentions, triage
from chartloom.plans.catalog import _AMBIGUOUS_RE2, _ENTITIES, _EVAL, _LABELLED, _TRIAGE, BASE, SENTENCES, _events, _labelled, _mentions, _prf_sql, _rounded, _sides, query
from chartloom.plans.wide import BASE as WIDE
from chartloom.sources.notes import clinical_notes, literal
from chartloom.sources.wide_notes import wide_notes

NONE = "CAST(NULL AS STRING)"


def values(rows, names: str) -> str:
    text = ", ".join("(" + ", ".join("NULL" if v is None else literal(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) AS t({names})"


_SEED = f", seed AS (SELECT lower(n) AS n, u AS system, c AS code, d AS display, r AS release_version, CASE k WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.4 ELSE 0.5 END AS confidence, l FROM ({values([(n, SYSTEM_URIS[s], c, d, r, k, s) for n, s, c, d, r, k in seed_rows()], 'n, u, c, d, r, k, l')}))"
_DIC = ", e AS (SELECT DISTINCT note_id, entity_type, lower(canonical_name) AS canonical_name FROM dic)"


def _dictionary_entities(spark, sf):
    return W.merged_entities(W.dictionary_mentions(wide_notes(spark, sf))).select("note_id", "entity_type", "canonical_name", "assertion")


# -- terminology -------------------------------------------------------------------------------------------------------
@query("trm_seed", "SELECT n AS canonical_name, system, code, display, release_version, CAST(confidence AS DOUBLE) AS confidence, coalesce(n_entities, 0) AS n_entities FROM seed LEFT JOIN (SELECT canonical_name, count(*) AS n_entities FROM e GROUP BY 1) ON n = canonical_name", WIDE + _DIC + _SEED)
def _(spark, sf):
    """The seed's codes, and how many entities of the notes have their name."""
    counts = _dictionary_entities(spark, sf).groupBy("canonical_name").agg(F.count("*").alias("n_entities"))
    return T.built_in_seed(spark).join(counts, "canonical_name", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0).cast("bigint")))


@query("trm_coded_entities", "SELECT e.note_id, e.entity_type, e.canonical_name, count(code) AS n_codes, coalesce(bool_or(release_version IS NOT NULL AND code IS NOT NULL), FALSE) AS is_coded, min(code) AS least_code FROM e LEFT JOIN seed ON n = canonical_name GROUP BY ALL", WIDE + _DIC + _SEED)
def _(spark, sf):
    coded = T.with_codings(_dictionary_entities(spark, sf), T.built_in_seed(spark), F.col("canonical_name"))
    return coded.select("note_id", "entity_type", "canonical_name", F.size("codings").cast("bigint").alias("n_codes"), T.is_coded(F.col("codings")).alias("is_coded"), F.array_min(F.transform("codings", lambda c: c["code"])).alias("least_code"))


@query("trm_preferred_system", f"SELECT e.note_id, e.canonical_name, count(code) AS n_codes FROM e LEFT JOIN (SELECT * FROM seed WHERE l = 'ICD-10-CM') ON n = canonical_name GROUP BY e.note_id, e.entity_type, e.canonical_name", WIDE + _DIC + _SEED)
def _(spark, sf):
    coded = T.with_codings(_dictionary_entities(spark, sf), T.built_in_seed(spark), F.col("canonical_name"), [SYSTEM_URIS["ICD-10-CM"]])
    return coded.select("note_id", "canonical_name", F.size("codings").cast("bigint").alias("n_codes"))


@query(
    "trm_manifest",
    f""", m AS (SELECT l, count(*) AS c, count(*) FILTER (e.note_id % 4 = 0) AS s, count(DISTINCT (e.note_id, e.entity_type, e.canonical_name)) AS k FROM e JOIN seed ON n = canonical_name GROUP BY l)
    SELECT CAST(ord AS INT) AS ord, system, coalesce(c, 0) AS n_candidates, coalesce(s, 0) AS n_selected, coalesce(k, 0) AS n_entities FROM ({values(list(enumerate(SYSTEMS)), 'ord, system')}) LEFT JOIN m ON l = system""",
    WIDE + _DIC + _SEED,
)
def _(spark, sf):
    coded = T.with_codings(_dictionary_entities(spark, sf), T.built_in_seed(spark), F.col("canonical_name"))
    return T.manifest(coded.select(F.struct("note_id", "entity_type", "canonical_name").alias("entity_id"), F.when(F.col("note_id") % 4 == 0, "selected").otherwise("candidate").alias("status"), "codings"))


@query(
    "trm_dynamic_key",
    """WITH x AS (SELECT event_id, event_id % 4 AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'lisinopril' WHEN 1 THEN 'lumbar mri' WHEN 2 THEN 'metformin' ELSE 'hypertension' END AS lookup_key, CASE WHEN k = 1 THEN 'mri' END AS modality, k = 1 AS has_modality_code FROM x""",
    "",
)
def _(spark, sf):
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "medication").when(k == 1, "imaging").when(k == 2, "plan").otherwise("problem")
    name = F.when(k == 0, "Zestril").when(k == 1, "Lumbar MRI").when(k == 2, "medication dose").otherwise("Hypertension")
    attributes = F.when(k == 0, F.create_map(F.lit("normalizedTerm"), F.lit("Lisinopril"))).when(k == 1, F.create_map(F.lit("modality"), F.lit("MRI"))).when(k == 2, F.create_map(F.lit("normalizedTerm"), F.lit("metformin"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = _events(spark, sf).select("event_id", kind.alias("entity_type"), name.alias("canonical_name"), attributes.alias("attributes"))
    coded = T.candidate_codings(rows, T.built_in_seed(spark))
    key, modality = T.lookup_key(F.col("entity_type"), F.col("canonical_name"), F.col("attributes")), T.modality_key(F.col("entity_type"), F.col("attributes"))
    return coded.select("event_id", key.alias("lookup_key"), modality.alias("modality"), F.exists("codings", lambda c: c["code"] == "113091000").alias("has_modality_code"))


_URLS = ("http://loinc.org", "http://snomed.info/sct", "http://hl7.org/fhir/sid/icd-10-cm", "urn:other", "x/rxnorm/cpt")


@query(
    "trm_expansion",
    """WITH x AS (SELECT event_id, event_id % 5 AS k FROM events WHERE event_id % 7 <> 0)
    SELECT event_id AS query_id, 0 AS ord, CASE WHEN event_id % 3 = 0 THEN 'CPT' ELSE CASE k WHEN 0 THEN 'LOINC' WHEN 1 THEN 'SNOMED-CT' WHEN 2 THEN 'ICD-10-CM' WHEN 4 THEN 'RxNorm' END END AS system, CAST(event_id AS STRING) AS code, CAST(0.4 AS DOUBLE) AS confidence, 'remote' AS provider FROM x WHERE k <> 3 OR event_id % 3 = 0
    UNION ALL SELECT event_id, 0, 'LOINC', 'local', CAST(0.4 AS DOUBLE), 'local' FROM events WHERE event_id % 7 = 0 OR (event_id % 5 = 3 AND event_id % 3 <> 0)""",
    "",
)
def _(spark, sf):
    e = _events(spark, sf)
    url = F.element_at(F.array(*[F.lit(u) for u in _URLS]), (F.col("event_id") % 5 + 1).cast("int"))
    entry = F.concat(F.lit('{"system":"'), url, F.lit('","code":"'), F.col("event_id").cast("string"), F.lit('","display":"d"}'))
    raw = F.when(F.col("event_id") % 7 == 0, "no json").otherwise(F.concat(F.lit('{"expansion":{"contains":['), entry, F.lit(',{"system":"http://loinc.org","display":"no code"}]}}')))
    remote = T.expansion(e.select(F.col("event_id").alias("query_id"), F.when(F.col("event_id") % 3 == 0, "CPT").alias("requested"), raw.alias("raw")))
    local = e.select(F.col("event_id").alias("query_id"), F.lit(0).alias("ord"), F.lit("LOINC").alias("system"), F.lit("local").alias("code"), F.lit("d").alias("display"), F.lit(0.4).alias("confidence"))
    return T.with_fallback(e.select(F.col("event_id").alias("query_id")), remote, local).select("query_id", "ord", "system", "code", "confidence", "provider")


@query("trm_labels", "WITH x AS (SELECT event_id, event_id % 7 AS k FROM events) SELECT event_id, CASE k " + " ".join(f"WHEN {i} THEN {literal(u)}" for i, u in enumerate(SYSTEM_URIS.values())) + " END AS uri, CASE k " + " ".join(f"WHEN {i} THEN {literal(n)}" for i, n in enumerate(SYSTEM_URIS)) + " ELSE 'urn:x' END AS label FROM x", "")
def _(spark, sf):
    name = F.try_element_at(F.array(*[F.lit(n) for n in SYSTEM_URIS]), (F.col("event_id") % 7 + 1).cast("int"))
    rows = _events(spark, sf).select("event_id", T.system_uri(name).alias("uri"))
    return rows.select("event_id", "uri", T.system_label(F.coalesce("uri", F.lit("urn:x"))).alias("label"))


@query("trm_merged_codings", "SELECT event_id, system, code, CASE WHEN event_id % 3 = 0 AND code = 'a' THEN 'own' WHEN code = 'a' OR code = 'b' THEN 'more' ELSE 'own' END AS origin FROM (SELECT event_id, 'LOINC' AS system, 'a' AS code FROM events UNION ALL SELECT event_id, 'LOINC', 'b' FROM events UNION ALL SELECT event_id, 'CPT', 'c' FROM events)", "")
def _(spark, sf):
    e = _events(spark, sf)
    table = lambda rows, origin: e.select("event_id", F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.lit(c).alias("code"), F.lit(o).alias("ord"), F.lit(keep).alias("keep")) for s, c, o, keep in rows])).alias("x")).select("event_id", "x.*", F.lit(origin).alias("origin"))
    own = table([("LOINC", "a", 0, 3), ("CPT", "c", 1, 1)], "own").where("event_id % keep = 0")
    more = table([("LOINC", "a", 0, 1), ("LOINC", "b", 1, 1), ("LOINC", "b", 2, 1)], "more")
    return T.merged_codings(own, more, ["event_id"]).select("event_id", "system", "code", "origin")


# -- gated export ------------------------------------------------------------------------------------------------------
_OPEN = """, x AS (SELECT note_id AS session_id, entity_type, canonical_text, row_number() OVER (PARTITION BY note_id ORDER BY first_start, entity_type, canonical_text) AS ord,
    list_aggregate(list_transform(string_split(canonical_text, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS display_name,
    CASE WHEN assertion = 'conflicting' THEN 'conflicting-assertion' WHEN assertion = 'unknown' THEN 'unknown-assertion' WHEN entity_type = 'risk' AND note_id % 2 = 1 THEN 'reviewer-ack-required' END AS why,
    CASE WHEN entity_type IN ('vital', 'score') AND note_id % 3 <> 0 THEN 'reviewed' ELSE 'unreviewed' END AS status FROM ent
), y AS (SELECT *, entity_type || '-' || CAST(ord AS STRING) AS id, bool_or(why IS NOT NULL) OVER (PARTITION BY session_id) AS stopped FROM x)"""


def _open_gate(spark, sf):
    """Entities gated without the interim rule; risks are acknowledged in even notes, every third note's escalation failed."""
    from pyspark.sql.window import Window

    log = _events(spark, sf).where("event_id % 2 = 0").select(F.col("event_id").alias("session_id"), F.lit(" dr a ").alias("reviewer_id"), F.array(F.lit("risk"), F.lit("vital")).alias("types"), F.col("ts").alias("at"))
    acked = G.acknowledged_types(G.acknowledgments(log))
    e = R.rollup(_mentions(spark, sf)).withColumnRenamed("note_id", "session_id")
    e = e.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("first_start", "entity_type", "canonical_text"))).join(acked, "session_id", "left")
    e = e.withColumn("id", F.concat_ws("-", "entity_type", F.col("ord").cast("string"))).withColumn("display_name", title_case(F.col("canonical_text")))
    return R.gate(e, F.col("acknowledged"), F.col("session_id") % 3 == 0, interim_strict=False)


_REFUSED = """'{"error":"export-blocked","blocked":[' || string_agg(CASE WHEN why IS NOT NULL THEN '{"id":"' || id || '","type":"' || entity_type || '","canonicalName":"' || canonical_text || '","reason":"' || why || '"}' END, ',' ORDER BY ord) || '],"exportType":"'"""


def _export_sql(kind: str, head: str, one: str, tail: str, between: str = "','") -> str:
    return f"""SELECT session_id, CASE WHEN any_value(stopped) THEN 409 ELSE 200 END AS status, CASE WHEN any_value(stopped) THEN {_REFUSED} || '{kind}"}}' ELSE {head} || string_agg({one}, {between} ORDER BY ord) || {tail} END AS payload FROM y GROUP BY session_id"""


@query("gate_export_json", _export_sql("json", """'{"exportType":"json","schemaVersion":"prototype-1","sessionId":"' || CAST(session_id AS STRING) || '","entities":['""", """'{"id":"' || id || '","canonicalName":"' || canonical_text || '","displayName":"' || display_name || '","type":"' || entity_type || '","reviewStatus":"' || status || '"}'""", "']}'"), BASE + _ENTITIES + _OPEN)
def _(spark, sf):
    return G.exports(_open_gate(spark, sf), "json")


@query("gate_export_fhir", _export_sql("fhir", """'{"exportType":"fhir","resourceType":"Bundle","type":"collection","entry":['""", """'{"resource":{"resourceType":"' || CASE WHEN entity_type IN ('vital', 'score') THEN 'Observation' ELSE 'Condition' END || '","code":{"text":"' || canonical_text || '"},"verificationStatus":"' || CASE status WHEN 'unreviewed' THEN 'unconfirmed' ELSE 'confirmed' END || '","provenance":"machine-extracted"}}'""", "']}'"), BASE + _ENTITIES + _OPEN)
def _(spark, sf):
    return G.exports(_open_gate(spark, sf), "fhir")


@query("gate_export_clipboard", _export_sql("clipboard", """'{"exportType":"clipboard","text":"'""", "display_name || ' (' || entity_type || '; ' || status || ')'", """'"}'""", "chr(92) || 'n'"), BASE + _ENTITIES + _OPEN)
def _(spark, sf):
    return G.exports(_open_gate(spark, sf), "clipboard")


@query("gate_outputs", "SELECT session_id, id, CASE WHEN why IS NULL THEN status ELSE 'blocked' END AS outcome FROM y", BASE + _ENTITIES + _OPEN)
def _(spark, sf):
    gated = _open_gate(spark, sf)
    return G.serializable(gated).select("session_id", "id", F.col("review_status").alias("outcome")).unionByName(G.blocked(gated).select("session_id", "id", F.lit("blocked").alias("outcome")))


_ACKS = "WITH l AS (SELECT user_id AS session_id, event_id, ts, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'r' || CAST(event_id % 3 AS STRING) END AS reviewer, unnest(CASE event_id % 3 WHEN 0 THEN ['risk', 'vital'] WHEN 1 THEN ['allergy', 'medication'] ELSE ['vital'] END) AS t FROM events)"


def _ack_log(spark, sf):
    types = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("risk"), F.lit("vital"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("allergy"), F.lit("medication"))).otherwise(F.array(F.lit("vital")))
    reviewer = F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")))
    return _events(spark, sf).select("event_id", F.col("user_id").alias("session_id"), reviewer.alias("reviewer_id"), types.alias("types"), F.struct("ts", "event_id").alias("at"))


@query("gate_acknowledgments", "SELECT session_id, entity_type, reviewer_id, event_id FROM (SELECT session_id, t AS entity_type, reviewer AS reviewer_id, event_id, row_number() OVER (PARTITION BY session_id, t ORDER BY ts DESC, event_id DESC) AS k FROM l WHERE trim(reviewer) <> '' AND t <> 'vital') WHERE k = 1", _ACKS)
def _(spark, sf):
    return G.acknowledgments(_ack_log(spark, sf)).select("session_id", "entity_type", "reviewer_id", F.col("at.event_id").alias("event_id"))


@query("gate_refused_acknowledgments", "SELECT event_id FROM events WHERE event_id % 4 = 0 OR event_id % 3 = 2", "")
def _(spark, sf):
    return G.refused_acknowledgments(_ack_log(spark, sf)).select("event_id")


_LISTED = ", x AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY first_start, entity_type, canonical_text) AS ord FROM ent)"


def _listed(spark, sf):
    from pyspark.sql.window import Window

    e = R.rollup(_mentions(spark, sf)).withColumnRenamed("note_id", "session_id")
    e = e.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("first_start", "entity_type", "canonical_text"))).withColumn("display_name", title_case(F.col("canonical_text")))
    attributes = F.when(F.col("entity_type") == "vital", F.create_map(F.lit("value"), F.col("mention_count").cast("string"), F.lit("unit"), F.lit("u"))).when(F.col("entity_type") == "score", F.create_map(F.lit("value"), F.lit("9")))
    return e.withColumn("attributes", attributes).withColumn("confidence", F.lit("high"))


@query("src_clipboard", """SELECT note_id AS session_id, string_agg(list_aggregate(list_transform(string_split(canonical_text, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' (' || entity_type || '; ' || assertion || '; high confidence' || CASE entity_type WHEN 'vital' THEN '; value ' || CAST(mention_count AS STRING) || ' u' WHEN 'score' THEN '; value 9' ELSE '' END || ')', chr(10) ORDER BY ord) AS summary FROM x GROUP BY note_id""", BASE + _ENTITIES + _LISTED)
def _(spark, sf):
    return G.clipboard_summary(_listed(spark, sf))


@query("agg_display_order", "SELECT note_id AS session_id, entity_type, canonical_text, CAST(row_number() OVER (PARTITION BY note_id ORDER BY CASE entity_type WHEN 'vital' THEN 5 WHEN 'score' THEN 7 WHEN 'severity' THEN 8 ELSE 9 END, entity_type, ord) AS INT) AS shown FROM x", BASE + _ENTITIES + _LISTED)
def _(spark, sf):
    return G.in_display_order(_listed(spark, sf)).select("session_id", "entity_type", "canonical_text", "shown")


@query("fhir_type_counts", "SELECT CASE WHEN entity_type IN ('vital', 'score', 'severity') THEN 'Observation' ELSE 'Condition' END AS resource_type, count(*) AS n FROM gold GROUP BY 1")
def _(spark, sf):
    from chartloom.operators.documents import resources

    return resources(_mentions(spark, sf)).groupBy("resource_type").agg(F.count("*").alias("n"))


# -- sessions ----------------------------------------------------------------------------------------------------------
def _imports(spark, sf):
    """One session an event, each eleventh of its own kind of fault."""
    k = F.col("event_id") % 11
    coding = F.concat(F.lit('{"system":"'), F.when(k == 5, "OTHER").otherwise("LOINC"), F.lit('","code":"1","display":"d","confidence":"low"}'))
    mention = F.when(k == 6, '{"text":"t","start":"0","end":1}').otherwise('{"text":"t","start":0,"end":1}')
    entity = F.concat(F.lit('{"id":"e","canonicalName":"n",'), F.when(k == 7, "").otherwise('"displayName":"N",'), F.lit('"type":"'), F.when(k == 8, "thing").otherwise("vital"), F.lit('","confidence":"high","mentions":['), mention, F.lit('],"codings":['), coding, F.lit('],"specialties":['), F.when(k == 9, '"x"').otherwise('"mixed"'), F.lit("]}"))
    whole = F.concat(F.lit('{"schemaVersion":"'), F.when(k == 2, "v0").otherwise("prototype-1"), F.lit('","specialty":"'), F.when(k == 3, "surgery").otherwise("mixed"), F.lit('",'), F.when(k == 4, "").otherwise('"sourceText":"a note",'), F.lit('"summary":{},'), F.when(k == 10, "").otherwise('"terminology":{},'), F.lit('"entities":['), entity, F.lit("]}"))
    return _events(spark, sf).select(F.col("event_id").alias("session_id"), F.when(k == 0, "not json").when(k == 1, "[1]").otherwise(whole).alias("raw"))


@query(
    "src_imports",
    """WITH x AS (SELECT event_id, event_id % 11 AS k FROM events) SELECT event_id AS session_id, k IN (5, 9, 10) AS ok,
    CASE k WHEN 0 THEN 'Import file is not valid JSON.' WHEN 1 THEN 'Imported file must contain a JSON object.' WHEN 2 THEN 'Unsupported or missing schemaVersion.' WHEN 3 THEN 'Missing or invalid specialty.' WHEN 4 THEN 'Missing sourceText.' WHEN 6 THEN 'Entity 1 mention 1 is invalid.'
      WHEN 7 THEN 'Entity 1 is missing displayName.' WHEN 8 THEN 'Entity 1 has invalid type.' ELSE '' END AS errors,
    CASE k WHEN 5 THEN 'Entity 1 coding 1 was dropped during import.' WHEN 9 THEN 'Entity 1 had no valid specialties.' WHEN 10 THEN 'Terminology manifest was rebuilt during import.' ELSE '' END AS warnings,
    CASE WHEN k IN (5, 9, 10) THEN 'a note' END AS source_text, CASE WHEN k IN (5, 9, 10) THEN 1 END AS n_entities FROM x""",
    "",
)
def _(spark, sf):
    rows = S.validated(_imports(spark, sf))
    return rows.select("session_id", "ok", F.array_join("errors", " | ").alias("errors"), F.array_join("warnings", " | ").alias("warnings"), "source_text", F.size("entities").alias("n_entities")).withColumn("n_entities", F.when(F.col("ok"), F.col("n_entities")))


@query("src_session_names", "SELECT note_id, CASE WHEN length(l) > 64 THEN l[1:61] || '...' ELSE l END AS name FROM (SELECT note_id, string_split(text, chr(10))[1] AS l FROM notes)")
def _(spark, sf):
    return clinical_notes(spark, sf).select("note_id", S.session_name(F.concat(F.lit("\n  \n"), F.col("text"))).alias("name"))


@query("src_library", "SELECT user_id AS session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 5, event_id DESC) AS k FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events)) WHERE k = 1 AND event_id % 5 <> 0", "")
def _(spark, sf):
    log = _events(spark, sf).select(F.col("user_id").alias("session_id"), "event_id", F.when(F.col("event_id") % 5 == 0, "delete").otherwise("save").alias("op"), F.struct("ts", (-(F.col("event_id") % 5)).alias("d"), "event_id").alias("saved_at"))
    return S.library(log).select("session_id", "event_id")


@query(
    "rev_codings",
    """WITH c AS (SELECT event_id AS entity_id, unnest(['a', 'b', 'c']) AS code FROM events), s AS (SELECT entity_id, code, 'LOINC' AS system FROM c UNION ALL SELECT event_id, 'd', 'CPT' FROM events)
    SELECT entity_id, system, code, CASE WHEN system = 'CPT' THEN CASE WHEN entity_id % 2 = 0 THEN 'selected' ELSE 'candidate' END
      WHEN code = 'a' THEN 'candidate' WHEN code = 'b' THEN CASE WHEN entity_id % 3 = 0 THEN 'rejected' ELSE 'selected' END ELSE CASE WHEN entity_id % 3 = 1 THEN 'rejected' ELSE 'candidate' END END AS status FROM s""",
    "",
)
def _(spark, sf):
    """a is selected first, then b, which is rejected again in every third; c is rejected in every third; d is selected in every second."""
    e = _events(spark, sf).select(F.col("event_id").alias("entity_id"))
    rows = lambda table: e.select("entity_id", F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.lit(c).alias("code"), F.lit(st).alias("status"), F.lit(at).alias("at"), F.lit(m).alias("m"), F.lit(r).alias("r")) for s, c, st, at, m, r in table])).alias("x")).select("entity_id", "x.*").where("entity_id % m = r").drop("m", "r")
    codings = rows([("LOINC", "a", "candidate", 0, 1, 0), ("LOINC", "b", "candidate", 0, 1, 0), ("LOINC", "c", "candidate", 0, 1, 0), ("CPT", "d", "candidate", 0, 1, 0)]).drop("at")
    events = rows([("LOINC", "a", "selected", 1, 1, 0), ("LOINC", "b", "selected", 2, 1, 0), ("LOINC", "b", "rejected", 3, 3, 0), ("LOINC", "c", "rejected", 1, 3, 1), ("CPT", "d", "selected", 1, 2, 0)])
    return S.reviewed(codings, events)


@query("rev_relations", "SELECT event_id AS relation_id, CASE WHEN event_id % 4 = 0 THEN 'rejected' WHEN event_id % 2 = 0 THEN 'accepted' ELSE 'candidate' END AS status FROM events", "")
def _(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("relation_id"))
    events = e.where("relation_id % 2 = 0").withColumn("status", F.lit("accepted")).withColumn("at", F.lit(1)).unionByName(e.where("relation_id % 4 = 0").withColumn("status", F.lit("rejected")).withColumn("at", F.lit(2)))
    return S.with_status(e.withColumn("status", F.lit("candidate")), events, ["relation_id"])


@query("rev_entities", "SELECT event_id AS entity_id, CASE WHEN event_id % 6 = 3 THEN 'Third' WHEN event_id % 2 = 0 THEN 'Second' ELSE 'First' END AS display_name, CASE WHEN event_id % 6 = 3 THEN 'absent' ELSE 'present' END AS assertion, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS review_status FROM events WHERE event_id % 5 <> 0", "")
def _(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("entity_id"))
    base = e.select("entity_id", F.lit("First").alias("display_name"), F.lit("present").alias("assertion"), F.lit("unreviewed").alias("review_status"))
    one = lambda when, op, name, assertion, at: e.where(when).select("entity_id", F.lit(op).alias("op"), F.lit(name).cast("string").alias("display_name"), F.lit(assertion).cast("string").alias("assertion"), F.lit(at).alias("at"))
    edits = one("entity_id % 2 = 0", "edit", "Second", None, 1).unionByName(one("entity_id % 6 = 3", "edit", "Third", "absent", 2)).unionByName(one("entity_id % 3 = 0", "review", None, None, 3)).unionByName(one("entity_id % 5 = 0", "delete", None, None, 4))
    return S.edited(base, edits)


@query("rev_manual_entities", """SELECT note_id, 'manual-finding-' || CAST(s AS STRING) || '-' || CAST(s + 4 AS STRING) AS entity_id, text[s + 1:s + 4] AS display_name, sentence FROM (SELECT n.note_id, n.text, 19 AS s, 'Mood is low.' AS sentence FROM notes n WHERE FALSE UNION ALL SELECT note_id, text, CAST(strpos(text, 'Mood') - 1 AS INT), 'Mood is low.' FROM notes WHERE template_id = 1 UNION ALL SELECT note_id, text, CAST(strpos(text, 'Mood') - 1 AS INT), 'Mood is poor.' FROM notes WHERE template_id = 10)""")
def _(spark, sf):
    notes = clinical_notes(spark, sf).where("template_id IN (1, 10)").withColumn("start", F.expr("CAST(locate('Mood', text) - 1 AS INT)"))
    rows = notes.select(F.col("note_id").alias("session_id"), "text", "start", (F.col("start") + 4).alias("end"), F.lit("finding").alias("entity_type"))
    blank = rows.withColumn("end", F.col("start")).withColumn("start", F.col("start") - 1)
    return S.manual_entities(rows.unionByName(blank)).select(F.col("session_id").alias("note_id"), "entity_id", "display_name", "sentence")


# -- the second look ---------------------------------------------------------------------------------------------------
def _lab_entities(spark, sf):
    k = F.col("event_id") % 8
    name = F.when(k < 3, "blood pressure").when(k == 3, "heart rate").when(k == 4, "Patient Health Questionnaire-9").when(k == 5, "Generalized Anxiety Disorder-7").otherwise("pain rating")
    n = (F.col("event_id") % 401).cast("string")
    attributes = F.when(k < 3, F.create_map(F.lit("systolic"), n, F.lit("diastolic"), (F.col("event_id") % 223).cast("string"))).when(k == 6, F.create_map(F.lit("value"), F.concat((F.col("event_id") % 13).cast("string"), F.lit("/10")))).when(k == 7, F.create_map(F.lit("severity"), (F.col("event_id") % 13).cast("string"), F.lit("value"), F.lit("3"))).otherwise(F.create_map(F.lit("value"), n))
    sentence = F.concat(F.lit("Sentence "), n, F.lit("."))
    return _events(spark, sf).select(F.col("event_id").alias("note_id"), F.lit(0).alias("ord"), F.lit("vital").alias("entity_type"), name.alias("canonical_name"), name.alias("display_name"), F.when(F.col("event_id") % 5 == 0, "low").otherwise("high").alias("confidence"), attributes.alias("attributes"), sentence.alias("sentence"))


_ISSUES = """WITH x AS (SELECT event_id AS note_id, event_id % 8 AS k, event_id % 401 AS n, event_id % 223 AS d, event_id % 13 AS p, event_id % 5 = 0 AS low FROM events),
i AS (SELECT note_id, 0 AS o, 'error' AS severity, 'Systolic BP ' || CAST(n AS STRING) || ' is outside 40-300.' AS message FROM x WHERE k < 3 AND n NOT BETWEEN 40 AND 300
UNION ALL SELECT note_id, 1, 'error', 'Diastolic BP ' || CAST(d AS STRING) || ' is outside 20-200.' FROM x WHERE k < 3 AND d NOT BETWEEN 20 AND 200
UNION ALL SELECT note_id, 2, 'error', 'Systolic BP should exceed diastolic BP.' FROM x WHERE k < 3 AND n <= d
UNION ALL SELECT note_id, 3, 'error', 'Heart rate ' || CAST(n AS STRING) || ' is outside 20-300.' FROM x WHERE k = 3 AND n NOT BETWEEN 20 AND 300
UNION ALL SELECT note_id, 4, 'error', 'PHQ-9 ' || CAST(n AS STRING) || ' is outside 0-27.' FROM x WHERE k = 4 AND n > 27
UNION ALL SELECT note_id, 5, 'error', 'GAD-7 ' || CAST(n AS STRING) || ' is outside 0-21.' FROM x WHERE k = 5 AND n > 21
UNION ALL SELECT note_id, 6, 'error', 'Pain rating ' || CAST(p AS STRING) || '/10 is outside 0-10.' FROM x WHERE k > 5 AND p > 10
UNION ALL SELECT note_id, 7, 'warning', 'Low-confidence extraction should be reviewed before model use.' FROM x WHERE low)"""


@query("lab_issues", "SELECT note_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY o) - 1 AS INT) AS k, severity, message FROM i", _ISSUES)
def _(spark, sf):
    return B.issues(_lab_entities(spark, sf)).select("note_id", "k", "severity", "message")


_LAB_TEXT = "Plain start here. Her mother and father came! A complex matter"
_BLOCKS = _ISSUES + """, b AS (SELECT note_id, 0 AS part, 0 AS o, 'Rules' AS route, 'vital ' || chr(183) || CASE WHEN low THEN ' low' ELSE ' high' END || ' confidence' AS reason, 'Sentence ' || CAST(n AS STRING) || '.' AS excerpt FROM x
  UNION ALL SELECT i.note_id, 1, o, 'LLM', message, 'Sentence ' || CAST(n AS STRING) || '.' FROM i JOIN x USING (note_id)
  UNION ALL SELECT note_id, 2, 1, 'LLM', 'Complex context trigger: mother', 'Her mother and father came!' FROM x
  UNION ALL SELECT note_id, 2, 2, 'LLM', 'Complex context trigger: complex', 'A complex matter' FROM x)"""


def _lab_notes(spark, sf):
    return _events(spark, sf).select(F.col("event_id").alias("note_id"), F.lit(_LAB_TEXT).alias("text"))


@query("lab_blocks", "SELECT note_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY part, o) AS INT) AS place, route, reason, excerpt FROM b", _BLOCKS)
def _(spark, sf):
    return B.triage_blocks(_lab_notes(spark, sf), _lab_entities(spark, sf))


@query("lab_context", "SELECT note_id, CASE WHEN has THEN s || chr(10) || 'Her mother and father came!' || chr(10) || 'A complex matter' ELSE 'Her mother and father came!' || chr(10) || 'A complex matter' || chr(10) || s END AS context FROM (SELECT x.note_id, 'Sentence ' || CAST(n AS STRING) || '.' AS s, x.note_id IN (SELECT note_id FROM i) AS has FROM x)", _BLOCKS)
def _(spark, sf):
    notes, entities = _lab_notes(spark, sf), _lab_entities(spark, sf)
    return B.compressed_context(notes, entities, B.triage_blocks(notes, entities))


@query("lab_snapshot", "SELECT x.note_id, CAST(1 AS BIGINT) AS n_rules, 2 + count(i.o) AS n_llm, count(i.o) AS n_issues FROM x LEFT JOIN i USING (note_id) GROUP BY x.note_id", _ISSUES)
def _(spark, sf):
    entities = _lab_entities(spark, sf)
    return B.snapshot(entities, B.triage_blocks(_lab_notes(spark, sf), entities))


@query("seg_plain_sentences", "SELECT note_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY k) - 1 AS INT) AS ord, s AS text FROM (SELECT note_id, trim(unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30) || '|\\n+'))) AS s, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30) || '|\\n+'), 1) AS k FROM notes) WHERE s <> ''")
def _(spark, sf):
    return clinical_notes(spark, sf).select("note_id", F.posexplode(B.plain_sentences(F.col("text"))).alias("ord", "text"))


# -- relations and abbreviations ---------------------------------------------------------------------------------------
_NAMES = (("metformin", "medication"), ("type 2 diabetes mellitus", "problem"), ("hemoglobin A1c", "lab"), ("lumbar mri", "imaging"), ("low back pain", "problem"), ("follow up", "plan"), ("safety plan", "other"), ("suicidal ideation", "risk"))


def _linked_entities(spark, sf):
    """Eight entities a note, 100 signs apart; those that stand side by side share a sentence."""
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("canonical_name"), F.lit(t).alias("entity_type")) for i, (n, t) in enumerate(_NAMES)])
    rows = _events(spark, sf).select(F.col("event_id").alias("note_id"), F.explode(each).alias("x")).select("note_id", "x.*")
    assertion = F.when((F.col("ord") == 3) & (F.col("note_id") % 2 == 0), "ordered").when((F.col("ord") == 4) & (F.col("note_id") % 3 == 0), "absent").otherwise("present")
    start = F.col("ord") * 100
    return rows.select("*", assertion.alias("assertion"), F.lit(None).cast("string").alias("body_site"), start.alias("start_char"), F.array(start).alias("starts"), F.array(F.floor(F.col("ord") / 2).cast("string")).alias("sentences"))


@query(
    "rel_links",
    """WITH x AS (SELECT event_id AS note_id, CASE WHEN event_id % 2 = 0 THEN 'ordered-for' ELSE 'documents' END AS r, event_id % 3 = 0 AS no_back FROM events)
    SELECT note_id, 0 AS source, 1 AS target, 'treats' AS relation, 'high' AS confidence FROM x UNION ALL SELECT note_id, 2, 1, 'measures', 'medium' FROM x UNION ALL SELECT note_id, 3, 4, r, 'medium' FROM x
    UNION ALL SELECT note_id, 5, 4, 'plan-for', 'low' FROM x WHERE NOT no_back UNION ALL SELECT note_id, 6, 7, 'supports', 'high' FROM x""",
    "",
)
def _(spark, sf):
    return N.relations(_linked_entities(spark, sf))


@query("abr_plain", "WITH x AS (SELECT event_id FROM events) SELECT event_id AS note_id, 'BP' AS abbreviation, 'blood pressure' AS canonical_name, CAST(2 AS BIGINT) AS mention_count FROM x UNION ALL SELECT event_id, 's/p', 'status post', 1 FROM x UNION ALL SELECT event_id, 'COPD', 'chronic obstructive pulmonary disease', 1 FROM x WHERE event_id % 2 = 0", "")
def _(spark, sf):
    text = F.concat(F.lit("BP high, bp. BPX is none; S/P surgery"), F.when(F.col("event_id") % 2 == 0, " COPD").otherwise(" COPDs"))
    notes = _events(spark, sf).select(F.col("event_id").alias("note_id"), text.alias("text"))
    return N.abbreviations_found(notes).select("note_id", "abbreviation", "canonical_name", "mention_count")


def _resolutions(spark, sf):
    each = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(a).alias("abbreviation"), F.lit(m).cast("string").alias("meaning"), F.lit(n).cast("string").alias("canonical_name"), F.lit(low).alias("low")) for p, a, m, n, low in ((0, "PT", None, None, True), (1, "CP", "chest pain", "chest pain", False), (2, "SI", "stroke index", None, True))])
    return _events(spark, sf).select(F.col("event_id").alias("note_id"), F.explode(each).alias("x")).select("note_id", "x.*")


@query("abr_open", "SELECT event_id AS note_id, 'ambiguous PT' AS canonical_name, 4 AS start_char, 6 AS end_char FROM events WHERE event_id % 2 = 0", "")
def _(spark, sf):
    notes = _events(spark, sf).select(F.col("event_id").alias("note_id"), F.when(F.col("event_id") % 2 == 0, "The pt, CP").otherwise("none").alias("text"))
    return N.open_abbreviations(notes, _resolutions(spark, sf)).select("note_id", "canonical_name", "start_char", "end_char")


@query("abr_attached", "SELECT event_id AS note_id, unnest([0, 1, 2]) AS ord, unnest(['CP', 'PT', NULL]) AS abbreviation, unnest(['high', 'low', 'high']) AS confidence FROM events", "")
def _(spark, sf):
    each = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("canonical_name"), F.array(F.lit(t)).alias("texts")) for o, n, t in ((0, "chest pain", "CP"), (1, "physical therapy", "pt"), (2, "angina", "cp"))])
    entities = _events(spark, sf).select(F.col("event_id").alias("note_id"), F.explode(each).alias("x"), F.lit("high").alias("confidence")).select("note_id", "x.*", "confidence")
    return N.with_disambiguation(entities, _resolutions(spark, sf)).select("note_id", "ord", "abbreviation", "confidence")


@query("ent_nested_symptoms", "SELECT event_id AS note_id, ord FROM (SELECT event_id, unnest([0, 1, 2]) AS ord FROM events) WHERE NOT (ord = 1 AND event_id % 2 = 0)", "")
def _(spark, sf):
    span = lambda a, b: F.struct(F.lit(a).alias("start_char"), F.lit(b).alias("end_char"))
    even = F.col("event_id") % 2 == 0
    each = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("problem").alias("entity_type"), F.lit("medium").alias("confidence"), F.array(span(0, 20), span(40, 60)).alias("mentions")),
        F.struct(F.lit(1).alias("ord"), F.lit("symptom").alias("entity_type"), F.when(even, "low").otherwise("high").alias("confidence"), F.array(span(5, 9), span(41, 44)).alias("mentions")),
        F.struct(F.lit(2).alias("ord"), F.lit("symptom").alias("entity_type"), F.lit("low").alias("confidence"), F.array(span(5, 9), span(30, 34)).alias("mentions")),
    )
    entities = _events(spark, sf).select(F.col("event_id").alias("note_id"), F.explode(each).alias("x")).select("note_id", "x.*")
    return N.without_nested_symptoms(entities).select("note_id", "ord")


# -- the cascade -------------------------------------------------------------------------------------------------------
def _fake_client():
    """Finds low mood in the excerpt.  The first answer is bad, each sixth of the excerpts (by length) in a way of its own;
    of one sixth, and where the excerpt says later, every answer is."""
    first = {
        0: "no json",
        1: '{"mentions": null}',
        2: '[{"text": "x", "entity_type": "score", "start_char": 0, "end_char": 1, "attributes": {"scale": "phq-9", "value": "many"}}]',
        3: '[{"text": "x", "entity_type": "nonsense", "start_char": 0, "end_char": 1, "assertion": "maybe"}]',
        4: '[{"text": "x", "entity_type": "score", "start_char": 0, "end_char": 1, "attributes": {"scale": "foo", "value": 99999}}]',
        5: '[{"text": "x", "entity_type": "symptom", "start_char": 0, "end_char": 1, "attributes": [1]}]',
    }

    def ask(messages):
        note = messages[-1]["content"].split("\n", 1)[1]
        if "later" in note.lower():
            return '[{"text": "x", "entity_type": "finding", "start_char": 0, "end_char": 1, "normalized_text": "manual muscle test", "attributes": {"value": "9/5"}}]'
        kind = len(note) % 6
        if kind == 5 or "refused" not in messages[0]["content"]:
            return first[kind]
        at = note.find("low mood")
        found = [{"text": "low", "entity_type": "symptom", "start_char": at, "end_char": at + 3, "assertion": "present", "confidence_score": 0.7, "normalized_text": "low mood", "attributes": {}}] if at >= 0 else []
        return json.dumps({"mentions": found})

    return ask


_STUCK = "(contains(lower(excerpt), 'later') OR length(excerpt) % 6 = 5)"
_CASCADE = f""", picked AS (SELECT s.note_id, s.ord, s.text FROM sent s WHERE regexp_matches(s.text, {literal(_AMBIGUOUS_RE2)}) OR EXISTS (SELECT 1 FROM gold g WHERE g.note_id = s.note_id AND contains(s.text, g.text))),
  shown AS (SELECT note_id, string_agg(text, chr(10) ORDER BY ord) AS excerpt FROM picked GROUP BY note_id),
  asked AS (SELECT t.note_id, t.text, coalesce(excerpt, t.text) AS excerpt FROM tri t LEFT JOIN shown USING (note_id) WHERE t.reasons <> ''),
  line AS (SELECT a.note_id, a.text, p.text AS said, row_number() OVER (PARTITION BY a.note_id ORDER BY p.ord) AS k FROM asked a JOIN picked p USING (note_id) WHERE contains(p.text, 'low mood') AND NOT {_STUCK})"""


@query("ext_hybrid", "SELECT note_id, entity_type, text, start_char, end_char, assertion FROM gold UNION ALL SELECT note_id, 'symptom', 'low', CAST(strpos(text, said) + strpos(said, 'low mood') - 2 AS INT), CAST(strpos(text, said) + strpos(said, 'low mood') + 1 AS INT), 'present' FROM line WHERE k = 1", BASE + SENTENCES + _TRIAGE + _CASCADE)
def _(spark, sf):
    mentions, _ = H.hybrid(clinical_notes(spark, sf).select("note_id", "text"), _fake_client)
    return mentions.select("note_id", "entity_type", "text", "start_char", "end_char", "assertion")


@query("ext_hybrid_outcomes", f"SELECT note_id, a.note_id IS NOT NULL AS escalated, a.note_id IS NOT NULL AND {_STUCK} AS escalation_failed FROM tri LEFT JOIN asked a USING (note_id)", BASE + SENTENCES + _TRIAGE + _CASCADE)
def _(spark, sf):
    return H.hybrid(clinical_notes(spark, sf).select("note_id", "text"), _fake_client)[1]


@query(
    "ext_model_errors",
    f"""SELECT note_id, CAST(3 AS INT) AS attempts, CASE WHEN contains(lower(excerpt), 'later') THEN 'mention[0] type=finding span=(0, 1): the strength grade is not from 0 to 5'
    ELSE 'mention[0] type=symptom span=(0, 1): attributes are no object of plain values' END AS error FROM asked WHERE {_STUCK}""",
    BASE + SENTENCES + _TRIAGE + _CASCADE,
)
def _(spark, sf):
    """What is told about the notes whose answers were all refused."""
    notes = clinical_notes(spark, sf).select("note_id", "text")
    routed = triage(notes, extract_mentions(notes), 2400).where("requires_llm").select("note_id", F.col("compressed_text").alias("text"))
    return H.model_answers(routed, _fake_client).where("mentions IS NULL").select("note_id", "attempts", "error")


@query("ext_prompts", f"SELECT note_id, 3 AS n_messages, {literal(H.SYSTEM_PROMPT)} || chr(10) || 'Your last answer was refused: fix it' AS first, 'Note:' || chr(10) || text AS last FROM notes")
def _(spark, sf):
    rows = clinical_notes(spark, sf).select("note_id", H.messages(F.col("text"), F.lit("fix it")).alias("m"))
    return rows.select("note_id", F.size("m").alias("n_messages"), F.col("m")[0]["content"].alias("first"), F.col("m")[2]["content"].alias("last"))


# -- wider evaluation --------------------------------------------------------------------------------------------------
def _one_corpus(rows):
    """Notes as one text, so that spans of different notes never overlap; every ninth note's rows lose their source."""
    shift = F.col("source_id") * 1000
    return rows.select(F.when(F.col("source_id") % 9 != 0, F.col("source_id")).alias("source_id"), (F.col("source_id") * 100 + F.col("idx")).alias("idx"), "entity_type", "text", (F.col("start_char") + shift).alias("start_char"), (F.col("end_char") + shift).alias("end_char"), "assertion")


@query("evl_any_source", "SELECT note_id, gold_ord, round(score, 6) AS score, exact FROM pairs WHERE score >= 0.5", BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    found = E.any_source_matches(E.any_source_pairs(_one_corpus(predicted), _one_corpus(gold)))
    return found.select(F.floor(F.col("g_idx") / 100).alias("note_id"), (F.col("g_idx") % 100).cast("int").alias("gold_ord"), F.round("score", 6).alias("score"), "exact")


_TOKENS = """, tp AS (SELECT note_id, gold_ord, entity_type, CASE WHEN note_id % 2 = 0 THEN text || ' noted' ELSE text END AS a, text AS b, start_char FROM gold),
  ts AS (SELECT *, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')) AS y FROM tp),
  tj AS (SELECT note_id, gold_ord, len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) AS score, note_id % 2 = 1 AS exact FROM ts)"""


@query("evl_token_strategy", "SELECT note_id, gold_ord, round(CAST(score AS DOUBLE), 6) AS score, exact FROM tj", BASE + _TOKENS)
def _(spark, sf):
    """Each mention against itself alone; in even notes the prediction is a word longer."""
    m = _mentions(spark, sf)
    gold = m.select(F.concat_ws("-", F.col("note_id").cast("string"), F.col("mention_idx").cast("string")).alias("source_id"), F.col("mention_idx").cast("bigint").alias("idx"), "entity_type", "text", "start_char", "end_char", "note_id")
    longer = F.col("note_id") % 2 == 0
    predicted = gold.withColumn("text", F.when(longer, F.concat("text", F.lit(" noted"))).otherwise(F.col("text"))).withColumn("end_char", F.when(longer, F.col("end_char") + 6).otherwise(F.col("end_char")))
    from chartloom.sources.notes import gold_mentions

    numbered = gold_mentions(clinical_notes(spark, sf), _events(spark, sf)).select("note_id", "start_char", "entity_type", "gold_ord")
    found = E.greedy_matches(E.candidate_pairs(predicted, gold, 0.3, strategy="token-jaccard"))
    back = found.join(gold.select("source_id", "note_id", "start_char", "entity_type"), ["source_id", "entity_type"]).join(numbered, ["note_id", "start_char", "entity_type"])
    return back.select("note_id", F.col("gold_ord").cast("int").alias("gold_ord"), F.round("score", 6).alias("score"), "exact")


@query("evl_mismatches", "SELECT note_id, gold_ord, pa AS predicted, ga AS gold FROM pairs WHERE score >= 0.5 AND pa <> ga", BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    rows = E.attribute_mismatches(predicted, gold, E.greedy_matches(E.candidate_pairs(predicted, gold)))
    return rows.select(F.col("source_id").alias("note_id"), F.col("g_idx").cast("int").alias("gold_ord"), "predicted", "gold")


@query("evl_assertion_classes", f"SELECT CAST(ord AS INT) AS ord, value, count(ga) FILTER (pa = ga) AS correct, count(ga) AS total, round(count(ga) FILTER (pa = ga) * 1.0 / nullif(count(ga), 0), 6) AS accuracy FROM ({values(list(enumerate(S.ASSERTIONS)), 'ord, value')}) LEFT JOIN (SELECT * FROM pairs WHERE score >= 0.5) ON ga = value GROUP BY ALL", BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    rows = E.class_accuracy(predicted, gold, E.greedy_matches(E.candidate_pairs(predicted, gold)), S.ASSERTIONS)
    return rows.withColumn("accuracy", F.round("accuracy", 6))


@query("evl_gate", "SELECT round(f1, 6) AS f1, f1 >= 0.39 AS passed, CASE WHEN f1 >= 0.39 THEN 0 ELSE 1 END AS exit_code FROM (" + _prf_sql("score >= 0.5").lstrip(", ").replace("u AS", "WITH u AS", 1) + ")", BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    return E.f1_gate(_rounded(E.metrics(predicted, gold, E.greedy_matches(E.candidate_pairs(predicted, gold))))).select("f1", "passed", "exit_code")


@query("evl_by_mode", _prf_sql("score >= 0.5", "mode").replace("FROM p UNION", "FROM (SELECT *, note_id % 3 AS mode FROM p) UNION").replace("FROM g UNION", "FROM (SELECT *, note_id % 3 AS mode FROM g) UNION").replace("FROM pairs", "FROM (SELECT *, note_id % 3 AS mode FROM pairs)"), BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    mode = (F.col("source_id") % 3).alias("mode")
    matches = E.greedy_matches(E.candidate_pairs(predicted, gold))
    return _rounded(E.metrics(*(df.select("*", mode) for df in (predicted, gold, matches)), by=["mode"]))


_SPECIALTIES = S.SPECIALTIES
_CASES = """, ex AS (SELECT DISTINCT note_id, canonical_text AS name FROM gold), fo AS (SELECT note_id, name FROM ex WHERE NOT (name = 'heart rate' AND note_id % 5 = 0) UNION ALL SELECT note_id, 'extra' FROM notes WHERE note_id % 7 = 0),
  ca AS (SELECT note_id, CASE note_id % 3 WHEN 0 THEN 'primary-care' WHEN 1 THEN 'mental-health' ELSE 'mixed' END AS specialty FROM notes),
  cr AS (SELECT ca.note_id, specialty, (SELECT count(*) FROM ex WHERE ex.note_id = ca.note_id) AS e, (SELECT count(*) FROM fo WHERE fo.note_id = ca.note_id) AS f, (SELECT count(*) FROM ex JOIN fo USING (note_id, name) WHERE ex.note_id = ca.note_id) AS m FROM ca)"""
_RATES = "CASE WHEN {f} = 0 THEN 1 ELSE {m} * 1.0 / {f} END AS pr, CASE WHEN {e} = 0 THEN 1 ELSE {m} * 1.0 / {e} END AS re"


def _cases(spark, sf):
    notes = clinical_notes(spark, sf)
    expected = _mentions(spark, sf).select(F.col("note_id").alias("case_id"), R.canonical().alias("name"))
    found = expected.where("NOT (name = 'heart rate' AND case_id % 5 = 0)").unionByName(notes.where("note_id % 7 = 0").select(F.col("note_id").alias("case_id"), F.lit("extra").alias("name")))
    specialty = F.when(F.col("note_id") % 3 == 0, "primary-care").when(F.col("note_id") % 3 == 1, "mental-health").otherwise("mixed")
    return E.case_results(expected, found, notes.select(F.col("note_id").alias("case_id"), specialty.alias("specialty")))


@query("evl_cases", f"SELECT note_id AS case_id, specialty, e AS expected_count, f AS found_count, m AS matched_count, round(CAST(pr AS DOUBLE), 6) AS precision, round(CAST(re AS DOUBLE), 6) AS recall, round(CAST(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS DOUBLE), 6) AS f1 FROM (SELECT *, {_RATES.format(e='e', f='f', m='m')} FROM cr)", BASE + _CASES)
def _(spark, sf):
    return _rounded(_cases(spark, sf)).drop("missed", "extra")


@query("evl_backlog", "SELECT note_id AS case_id, specialty, 'heart rate' AS name FROM ca WHERE note_id % 5 = 0 AND note_id IN (SELECT note_id FROM ex WHERE name = 'heart rate')", BASE + _CASES)
def _(spark, sf):
    return E.backlog(_cases(spark, sf))


@query("evl_hotspots", "SELECT row_number() OVER (ORDER BY e + f - 2 * m DESC, note_id) AS place, note_id AS case_id, CAST(e + f - 2 * m AS INT) AS gap FROM cr WHERE e + f > 2 * m", BASE + _CASES)
def _(spark, sf):
    return E.hotspots(_cases(spark, sf)).select(F.col("place").cast("bigint").alias("place"), "case_id", "gap")


@query("evl_by_specialty", f"SELECT specialty, CAST(coalesce(e, 0) AS BIGINT) AS expected_count, CAST(coalesce(f, 0) AS BIGINT) AS found_count, CAST(coalesce(m, 0) AS BIGINT) AS matched_count, round(CAST(pr AS DOUBLE), 6) AS precision, round(CAST(re AS DOUBLE), 6) AS recall FROM (SELECT specialty, e, f, m, {_RATES.format(e='coalesce(e, 0)', f='coalesce(f, 0)', m='m')} FROM ({values([(s,) for s in _SPECIALTIES], 'specialty')}) LEFT JOIN (SELECT specialty, sum(e) AS e, sum(f) AS f, sum(m) AS m FROM cr GROUP BY 1) USING (specialty))", BASE + _CASES)
def _(spark, sf):
    return E.by_specialty(_cases(spark, sf), _SPECIALTIES).select("specialty", "expected_count", "found_count", "matched_count", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("evl_coverage", "SELECT 'type' AS dimension, entity_type AS key, count(*) AS found_count, count(*) FILTER (note_id % 2 = 0) AS coded_count FROM ent GROUP BY 2 UNION ALL SELECT 'assertion', assertion, count(*), count(*) FILTER (note_id % 2 = 0) FROM ent GROUP BY 2", BASE + _ENTITIES)
def _(spark, sf):
    return E.coverage(R.rollup(_mentions(spark, sf)).withColumn("n_codings", 1 - F.col("note_id") % 2))


@query(
    "evl_coverage_order",
    "SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY found_count DESC, key) AS place, key, found_count FROM (SELECT 'type' AS dimension, entity_type AS key, count(*) AS found_count FROM ent GROUP BY 2 UNION ALL SELECT 'assertion', assertion, count(*) FROM ent GROUP BY 2)",
    BASE + _ENTITIES,
)
def _(spark, sf):
    rows = E.coverage(R.rollup(_mentions(spark, sf)).withColumn("n_codings", F.lit(0)))
    return E.in_order(rows, ["dimension"]).select("dimension", F.col("place").cast("bigint").alias("place"), "key", "found_count")


@query("evl_ambiguity", "SELECT event_id AS case_id, CAST(2 AS BIGINT) AS expected_count, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS matched_count, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'PT=physical therapy' END AS missed FROM events", "")
def _(spark, sf):
    rows = lambda table: _events(spark, sf).select(F.col("event_id").alias("case_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("abbreviation"), F.lit(m).alias("meaning")) for a, m in table])).alias("x")).select("case_id", "x.*")
    both = [("PT", "physical therapy"), ("CP", "chest pain")]
    resolved = rows(both[1:]).unionByName(rows(both[:1]).where("case_id % 2 = 0")).unionByName(rows([("PT", "patient")]))
    return E.ambiguity_results(rows(both), resolved).withColumn("missed", F.array_join("missed", ","))


@query("agg_pair_auc", ", b AS (SELECT mode, y, s FROM lab UNION ALL SELECT 'one class', 1, s FROM lab), h AS (SELECT mode, s, sum(y) AS p, count(*) - sum(y) AS q FROM b GROUP BY ALL) SELECT a.mode, round(coalesce(sum(a.p * b.q * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / nullif(sum(a.p * b.q), 0), 0), 6) AS roc_auc FROM h a JOIN h b ON a.mode = b.mode GROUP BY a.mode", BASE + _LABELLED)
def _(spark, sf):
    rows = _labelled(spark, sf)
    one = rows.withColumn("y_true", F.lit(1)).withColumn("mode", F.lit("one class"))
    return E.pair_auc(rows.unionByName(one), by=["mode"]).withColumn("roc_auc", F.round("roc_auc", 6))


# -- exchange resources in full ----------------------------------------------------------------------------------------
_KINDS = (
    ("problem", "hypertension", {}), ("vital", "blood pressure", {"systolic": "120", "diastolic": "80"}), ("vital", "heart rate", {"value": "72", "unit": "beats/min"}), ("medication", "lisinopril", {"dose": "10 mg"}),
    ("allergy", "penicillin", {"severity": "high", "reaction": "rash"}), ("referral", "physical therapy", {}), ("procedure", "colonoscopy", {}), ("finding", "gait", {"value": "steady"}),
)


def _exchange(spark, sf):
    e = _events(spark, sf)
    k = (F.col("event_id") % len(_KINDS)).cast("int")
    pick = lambda values_: F.element_at(F.array(*values_), k + 1)
    attributes = pick([F.create_map(*[F.lit(x) for kv in a.items() for x in kv]) if a else F.create_map().cast("map<string,string>") for _, _, a in _KINDS])
    status = F.when(F.col("event_id") % 3 == 0, "rejected").when(F.col("event_id") % 3 == 1, "selected").otherwise("candidate")
    coding = lambda code, s: F.struct(F.lit("LOINC").alias("system"), F.lit(code).alias("code"), F.lit("d").alias("display"), s.alias("status"))
    return e.select(
        F.col("event_id").alias("note_id"), F.lit(0).alias("ord"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), pick([F.lit(t) for t, _, _ in _KINDS]).alias("entity_type"), pick([F.lit(n) for _, n, _ in _KINDS]).alias("canonical_name"),
        F.lit("Name").alias("display_name"), F.when(F.col("event_id") % 5 == 0, "absent").otherwise("present").alias("assertion"), attributes.alias("attributes"), F.array(coding("a", status), coding("b", F.lit("candidate"))).alias("codings"),
        F.array(F.struct(F.lit(0).alias("start_char"), F.lit(4).alias("end_char"), F.lit("name").alias("text"))).alias("mentions"),
    )


def _fhir_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    code = """'{"coding":[' || CASE WHEN s = 0 THEN '{"system":"http://loinc.org","code":"b","display":"d"}' WHEN s = 1 THEN '{"system":"http://loinc.org","code":"a","display":"d"}' ELSE '{"system":"http://loinc.org","code":"a","display":"d"},{"system":"http://loinc.org","code":"b","display":"d"}' END || '],"text":"Name"}'"""
    status = lambda system, yes, no: f"""'{{"coding":[{{"system":"http://terminology.hl7.org/CodeSystem/{system}","code":"' || CASE WHEN absent THEN '{no}","display":"{no.capitalize()}' ELSE '{yes}","display":"{yes.capitalize()}' END || '"}}]}}'"""
    note = q(',"note":[{"text":"Source span 0-4: name"}]}')
    subject = q(',"subject":{"display":"Prototype patient"}')
    head = lambda kind: f"""'{{"resourceType":"{kind}","id":"e' || CAST(event_id AS STRING) || '"'"""
    clinical = lambda a, b: f"""',"clinicalStatus":' || {status(a, 'active', 'inactive')} || ',"verificationStatus":' || {status(b, 'unconfirmed', 'refuted')}"""
    vital = q(',"category":[{"coding":[{"system":"http://terminology.hl7.org/CodeSystem/observation-category","code":"vital-signs","display":"Vital Signs"}],"text":"Vital Signs"}]')
    part = lambda c, d, v: f'{{"code":{{"coding":[{{"system":"http://loinc.org","code":"{c}","display":"{d}"}}],"text":"{d}"}},"valueQuantity":{{"value":{v}.0,"unit":"mmHg","system":"http://unitsofmeasure.org","code":"mm[Hg]"}}}}'
    pressure = q(f',"component":[{part("8480-6", "Systolic blood pressure", 120)},{part("8462-4", "Diastolic blood pressure", 80)}]')
    rate = q(',"valueQuantity":{"value":72.0,"unit":"beats/min","system":"http://unitsofmeasure.org","code":"{beats}/min"}')
    final, coded = q(',"status":"final"'), f"""',"code":' || {code}"""
    cases = [
        f"{head('Condition')} || {clinical('condition-clinical', 'condition-ver-status')} || {coded} || {subject} || {note}",
        f"{head('Observation')} || {final} || {coded} || {vital} || {subject} || {pressure} || {note}",
        f"{head('Observation')} || {final} || {coded} || {vital} || {subject} || {rate} || {note}",
        f"""{head('MedicationStatement')} || ',"status":"' || CASE WHEN absent THEN 'not-taken' ELSE 'active' END || '","medicationCodeableConcept":' || {code} || {subject} || {q(',"dosage":[{"text":"10 mg"}]')} || {note}""",
        f"{head('AllergyIntolerance')} || {clinical('allergyintolerance-clinical', 'allergyintolerance-verification')} || {q(',\"criticality\":\"high\"')} || {coded} || {q(',\"patient\":{\"display\":\"Prototype patient\"},\"reaction\":[{\"manifestation\":[{\"text\":\"rash\"}]}]')} || {note}",
        f"{head('ServiceRequest')} || {q(',\"status\":\"active\",\"intent\":\"plan\"')} || {coded} || {subject} || {note}",
        f"{head('Procedure')} || {q(',\"status\":\"completed\"')} || {coded} || {subject} || {note}",
        f"{head('Observation')} || {final} || {coded} || {subject} || {q(',\"valueString\":\"steady\"')} || {note}",
    ]
    return "WITH x AS (SELECT event_id, event_id % 8 AS k, event_id % 3 AS s, event_id % 5 = 0 AS absent FROM events) SELECT event_id AS note_id, CASE k " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END AS body FROM x"


@query("fhir_full_resources", _fhir_sql(), "")
def _(spark, sf):
    return X.resources(_exchange(spark, sf)).select("note_id", "body")


_FAULTS = (
    "not json", '{"resourceType":"Bundle","type":"document"}', '{"resourceType":"Bundle","type":"collection","entry":[1,{"fullUrl":"x"},{"fullUrl":"urn:uuid:1","resource":{}}]}',
    '{"resourceType":"Bundle","type":"collection","entry":[{"fullUrl":"urn:uuid:1","resource":{"resourceType":"Observation","subject":{},"code":{"coding":[{"system":"loinc"},2]}}}]}',
    '{"resourceType":"Other","type":"collection","entry":[{"fullUrl":"urn:uuid:1","resource":{"resourceType":"ServiceRequest","id":"r"}}]}',
)
_SAID = (
    (False, "FHIR payload must be an object.", "", 0),
    (False, "FHIR Bundle must include an entry array.", "Prototype FHIR Bundle should use type=collection.", 0),
    (False, "FHIR entry 1 must be an object. | FHIR entry 2 is missing a resource object. | FHIR entry 3 resource is missing resourceType.", "FHIR entry 2 should use a urn:uuid fullUrl.", 0),
    (False, "FHIR Observation entry 1 is missing id. | FHIR Observation entry 1 is missing status.", "FHIR Observation entry 1 coding 1 has no absolute terminology system URI. | FHIR Observation entry 1 coding 1 is missing code. | FHIR Observation entry 1 coding 2 is not an object. | FHIR Observation entry 1 has no value or component.", 1),
    (False, "FHIR payload resourceType must be Bundle. | FHIR ServiceRequest entry 1 is missing intent.", "FHIR ServiceRequest entry 1 has no prototype subject/patient. | FHIR ServiceRequest entry 1 has no code text or coding.", 1),
    (True, "", "", 1),
)


def _bundles(spark, sf):
    good = X.bundles(X.resources(_exchange(spark, sf)))
    k = (F.col("note_id") % 6).cast("int")
    return good.select("note_id", F.coalesce(F.try_element_at(F.array(*[F.lit(b) for b in _FAULTS]), k + 1), "body").alias("body"))


def _quality_case(i: int) -> str:
    return " ".join(f"WHEN {k} THEN {('TRUE' if s[i] else 'FALSE') if isinstance(s[i], bool) else literal(s[i]) if isinstance(s[i], str) else s[i]}" for k, s in enumerate(_SAID))


@query("fhir_quality", f"SELECT event_id AS note_id, CASE event_id % 6 {_quality_case(0)} END AS ok, CASE event_id % 6 {_quality_case(1)} END AS errors, CASE event_id % 6 {_quality_case(2)} END AS warnings, CAST(CASE event_id % 6 {_quality_case(3)} END AS INT) AS resource_count FROM events", "")
def _(spark, sf):
    rows = X.bundle_quality(_bundles(spark, sf))
    return rows.select("note_id", "ok", F.array_join("errors", " | ").alias("errors"), F.array_join("warnings", " | ").alias("warnings"), "resource_count")


@query("fhir_preview_check", f"SELECT event_id AS note_id, CASE event_id % 6 {_quality_case(0)} END AS ok, CASE event_id % 6 WHEN 0 THEN 'FHIR preview must be a JSON object.' WHEN 4 THEN 'FHIR preview resourceType must be Bundle.' ELSE CASE event_id % 6 {_quality_case(1)} END END AS errors FROM events", "")
def _(spark, sf):
    return X.bundle_check(_bundles(spark, sf)).select("note_id", "ok", F.array_join("errors", " | ").alias("errors"))


@query("fhir_units", "WITH x AS (SELECT event_id, event_id % 10 AS k FROM events) SELECT event_id, CASE k " + " ".join(f"WHEN {i} THEN {literal(c)}" for i, c in enumerate(X.UCUM.values())) + " WHEN 8 THEN 'points' END AS code FROM x", "")
def _(spark, sf):
    unit = F.try_element_at(F.array(*[F.lit(u) for u in (*X.UCUM, "points", "")]), (F.col("event_id") % 10 + 1).cast("int"))
    return _events(spark, sf).select("event_id", X.ucum(unit).alias("code"))


@query(
    "src_reviewer_report",
    """SELECT event_id AS session_id, '# Clinical Entity Extraction Review' || chr(10) || chr(10) || 'Specialty: Mixed' || chr(10) || 'Entity count: 1' || chr(10) || 'Reviewed: ' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END || chr(10) || 'Selected codes: ' || CASE WHEN event_id % 3 = 1 THEN '1' ELSE '0' END
      || chr(10) || 'High priority review: ' || CASE WHEN event_id % 7 = 0 THEN '1' ELSE '0' END || chr(10) || chr(10) || '## Entities' || chr(10) || '### Name' || chr(10) || 'Type: ' || CASE event_id % 8 """
    + " ".join(f"WHEN {i} THEN {literal(t)}" for i, (t, _, _) in enumerate(_KINDS))
    + """ END || chr(10) || 'Assertion: ' || CASE WHEN event_id % 5 = 0 THEN 'absent' ELSE 'present' END || chr(10) || 'Confidence: high' || chr(10) || 'Review: ' || CASE WHEN event_id % 2 = 0 THEN 'reviewed' ELSE 'unreviewed' END || chr(10) || 'Selected codes: ' || CASE WHEN event_id % 3 = 1 THEN 'LOINC a' ELSE 'none' END
      || chr(10) || 'Source: "name"' || CASE WHEN event_id % 4 = 0 THEN chr(10) || 'Reviewer note: seen' ELSE '' END || chr(10) || chr(10) || '## Source Text' || chr(10) || '(blank)' AS report FROM events""",
    "",
)
def _(spark, sf):
    e = _exchange(spark, sf).withColumnRenamed("note_id", "session_id")
    own = F.col("session_id")
    rows = e.select("session_id", "ord", "display_name", "entity_type", "assertion", F.lit("high").alias("confidence"), F.when(own % 2 == 0, "reviewed").alias("review_status"), F.when(own % 4 == 0, "seen").otherwise("").alias("review_note"), F.when(own % 7 == 0, "high").otherwise("routine").alias("priority"), "codings", F.transform("mentions", lambda m: m["text"]).alias("texts"))
    return X.reviewer_report(e.select("session_id", F.lit("Mixed").alias("specialty_label"), F.lit("  ").alias("text")), rows)


# -- the wide extraction composed --------------------------------------------------------------------------------------
_WHOLE = """, rows0 AS (SELECT note_id, entity_type, lower(canonical_name) AS canonical_name, start_char, length(text) AS n FROM dic UNION SELECT note_id, entity_type, lower(canonical_name), start_char, length(text) FROM fam),
  ent0 AS (SELECT note_id, entity_type, canonical_name, min(start_char) AS first_start FROM rows0 GROUP BY ALL),
  nested AS (SELECT DISTINCT s.note_id, s.canonical_name FROM rows0 s JOIN rows0 p USING (note_id) WHERE s.entity_type = 'symptom' AND p.entity_type = 'problem' AND p.start_char <= s.start_char AND s.start_char + s.n <= p.start_char + p.n AND p.n > s.n)"""


@query("ext_documents", "SELECT note_id, entity_type, canonical_name, first_start, count(code) AS n_codes FROM ent0 LEFT JOIN seed ON n = canonical_name WHERE NOT (entity_type = 'symptom' AND (note_id, canonical_name) IN (SELECT (note_id, canonical_name) FROM nested)) GROUP BY ALL", WIDE + _WHOLE + _SEED)
def _(spark, sf):
    from chartloom.operators.composed import documents

    found = documents(wide_notes(spark, sf).select("note_id", "text")).where("entity_type <> 'other' OR NOT canonical_name LIKE 'ambiguous%'")
    return found.select("note_id", "entity_type", "canonical_name", "first_start", F.size("codings").cast("bigint").alias("n_codes"))


@query("ext_merged_attributes", "SELECT event_id AS note_id, CASE WHEN event_id % 2 = 0 THEN 'v3' ELSE 'v1' END AS value, 'u1' AS unit, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN event_id % 2 = 0 THEN 'one two' ELSE 'one' END AS explanation FROM events", "")
def _(spark, sf):
    from chartloom.operators.composed import merged_attributes

    row = lambda o, a, c, x: F.struct(F.lit(o).alias("ord"), F.create_map(*[F.lit(y) for kv in a.items() for y in kv]).alias("attributes"), F.lit(c).alias("confidence"), F.lit(x).alias("explanation"))
    each = F.array(row(0, {"value": "v1", "unit": "u1"}, "medium", "one"), row(1, {"value": "v3"}, "high", "two"), row(2, {"value": "v3"}, "low", "one"))
    rows = _events(spark, sf).select(F.col("event_id").alias("note_id"), F.explode(each).alias("x")).select("note_id", "x.*").where("ord = 0 OR note_id % 2 = 0")
    out = merged_attributes(rows, ["note_id"])
    return out.select("note_id", F.col("attributes")["value"].alias("value"), F.col("attributes")["unit"].alias("unit"), "confidence", "explanation")


@query("ctx_extraction_specialties", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'primary-care,mental-health,physical-therapy,mixed' WHEN event_id % 4 = 1 THEN 'mental-health' ELSE 'active' END AS specialties FROM events", "")
def _(spark, sf):
    from chartloom.operators.composed import extraction_specialties

    k = F.col("event_id") % 4
    chosen = extraction_specialties(F.when(k == 0, "mixed").when(k < 3, "mental-health"), F.when(k == 2, "auto").otherwise("override"), F.array(F.lit("active")))
    return _events(spark, sf).select("event_id", F.array_join(chosen, ",").alias("specialties"))


@query("ext_display_case", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Lumbar Spine MRI' WHEN 1 THEN 'Follow-Up' ELSE 'A1C  Value' END AS shown FROM events", "")
def _(spark, sf):
    from chartloom.operators.composed import display_case

    name = F.when(F.col("event_id") % 3 == 0, "lumbar SPINE mri").when(F.col("event_id") % 3 == 1, "follow-up").otherwise("a1c  value")
    return _events(spark, sf).select("event_id", display_case(name).alias("shown"))
