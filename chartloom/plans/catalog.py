"""Registered queries over the derived notes, each with the SQL another engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import lexicon as L
from chartloom.functions.spans import sentence_spans
from chartloom.operators import evaluation as E
from chartloom.operators import features as X
from chartloom.operators import rollup as R
from chartloom.operators import validation as V
from chartloom.operators.extraction import extract_mentions, merge_mentions, remap_to_source, triage
from chartloom.operators.sections import section_at, sections
from chartloom.sources.notes import clinical_notes, filled, gold_mentions, gold_sql, literal, notes_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Materialized, since an engine would else plan the union of all templates anew wherever a query names it.
BASE = f"WITH notes AS MATERIALIZED ({notes_sql()}), gold0 AS ({gold_sql()}), gold AS MATERIALIZED (SELECT *, lower(normalized_text) AS canonical_text FROM gold0)"
#: Sentences in an engine without look-ahead: a mark after each end sign that white space or the end follows, then a split.
SENTENCES = r""", sent0 AS (
  SELECT note_id, template_id, unnest(string_split_regex(regexp_replace(text, '([.!?])(\s|$)', '\1' || chr(30) || '\2', 'g'), chr(30) || '|\n+')) AS s,
         generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])(\s|$)', '\1' || chr(30) || '\2', 'g'), chr(30) || '|\n+'), 1) AS k FROM notes
), sent AS (SELECT note_id, template_id, trim(s, ' ' || chr(10)) AS text, row_number() OVER (PARTITION BY note_id ORDER BY k) - 1 AS ord FROM sent0 WHERE trim(s, ' ' || chr(10)) <> '')"""


def query(name: str, sql: str | None = None, base: str = BASE) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"{base} {sql}"
        return f

    return add


def _mentions(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return extract_mentions(clinical_notes(spark, sf), keep=("note_id", *keep))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


# -- segmentation and extraction ---------------------------------------------------------------------------------------
@query("seg_sentences", "SELECT note_id, CAST(ord AS INT) AS ord, text FROM sent", BASE + SENTENCES)
def _(spark, sf):
    rows = clinical_notes(spark, sf).select("note_id", F.posexplode(sentence_spans(F.col("text"))).alias("ord", "s"))
    return rows.select("note_id", "ord", "s.text")


_SECTION_TRUTH = [
    (15, 0, "chief-complaint", "Chief Complaint", "pain {pain}/10"),
    (15, 1, "assessment", "Assessment", "complex presentation, unclear cause."),
    (15, 2, "plan", "Plan", "monitor for SI."),
    (20, 0, "history-of-present-illness", "History Of Present Illness", "54 year old with HTN. Seen in clinic for {wk} weeks of cough."),
    (20, 1, "medications", "Medications", "lisinopril {mg} mg daily"),
    (20, 2, "plan", "Plan", "follow up."),
    (21, 0, "subjective", "Subjective", "right knee pain {pain}/10 for {wk} weeks."),
    (21, 1, "objective", "Objective", "gait antalgic, TUG 14 sec."),
    (21, 2, "assessment-plan", "Assessment Plan", "PT 2x/week."),
]
_SECTION_SQL = " UNION ALL ".join(
    f"SELECT note_id, {o} AS ord, {literal(n)} AS name, {literal(t)} AS title, {filled(c)} AS content FROM notes JOIN events ON note_id = event_id WHERE template_id = {k}" for k, o, n, t, c in _SECTION_TRUTH
)


@query("seg_sections", f"{_SECTION_SQL} UNION ALL SELECT note_id, 0, 'unknown', 'Unsectioned note', text FROM notes WHERE template_id NOT IN (15, 20, 21)")
def _(spark, sf):
    rows = clinical_notes(spark, sf).select("note_id", "text", F.posexplode(sections(F.col("text"))).alias("ord", "s"))
    return rows.select("note_id", "ord", "s.name", "s.title", F.trim(F.regexp_replace(F.expr("substring(text, s.start + 1, s.end - s.start)"), r"^\s+|\s+$", "")).alias("content"))


@query(
    "seg_section_of_mention",
    "SELECT note_id, start_char, CASE WHEN template_id = 15 AND gold_ord = 28 THEN 'chief-complaint' WHEN template_id = 15 THEN 'plan' WHEN template_id = 21 THEN 'subjective' ELSE 'unknown' END AS section FROM gold JOIN notes USING (note_id)",
)
def _(spark, sf):
    notes = clinical_notes(spark, sf).withColumn("sections", sections(F.col("text")))
    rows = extract_mentions(notes, keep=("note_id", "sections"))
    return rows.select("note_id", "start_char", section_at(F.col("sections"), F.col("start_char"))["name"].alias("section"))


@query("ext_mentions", "SELECT note_id, entity_type, text, normalized_text, start_char, end_char, assertion, decision, trigger_text FROM gold")
def _(spark, sf):
    return _mentions(spark, sf).select("note_id", "entity_type", "text", "normalized_text", "start_char", "end_char", "assertion", "decision", F.col("trigger").alias("trigger_text"))


@query(
    "ext_attributes",
    r"""SELECT note_id, start_char,
      CASE WHEN normalized_text IN ('heart rate', 'PHQ-9') THEN regexp_extract(text, '(\d+)$', 1) WHEN normalized_text = 'pain rating' THEN regexp_extract(text, '(\d+)/10', 1) END AS value,
      CASE WHEN normalized_text = 'blood pressure' THEN regexp_extract(text, '(\d+)/', 1) END AS systolic,
      CASE WHEN normalized_text = 'blood pressure' THEN regexp_extract(text, '/(\d+)', 1) END AS diastolic,
      CASE normalized_text WHEN 'heart rate' THEN 'beats/min' WHEN 'blood pressure' THEN 'mmHg' END AS unit FROM gold""",
)
def _(spark, sf):
    get = lambda k: F.try_element_at("attributes", F.lit(k)).alias(k)
    return _mentions(spark, sf).select("note_id", "start_char", get("value"), get("systolic"), get("diastolic"), get("unit"))


_PSYCH_RE2 = L.PSYCH_CONTEXT


@query(
    "ext_si_guard",
    f"""SELECT g.note_id, g.start_char, CASE WHEN g.text = 'SI' AND NOT regexp_matches(n.text, {literal(_PSYCH_RE2)}) THEN 0.4 ELSE 0.86 END AS confidence,
      g.text = 'SI' AND NOT regexp_matches(n.text, {literal(_PSYCH_RE2)}) AS flagged FROM gold g JOIN notes n USING (note_id) WHERE g.entity_type = 'risk'""",
)
def _(spark, sf):
    rows = _mentions(spark, sf).where("entity_type = 'risk'")
    return rows.select("note_id", "start_char", F.col("confidence_score").alias("confidence"), F.try_element_at("attributes", F.lit("review_reason")).isNotNull().alias("flagged"))


@query("ext_mention_index", "SELECT note_id, start_char, CAST(row_number() OVER (PARTITION BY note_id ORDER BY start_char, end_char, entity_type) - 1 AS INT) AS mention_idx FROM gold")
def _(spark, sf):
    return _mentions(spark, sf).select("note_id", "start_char", "mention_idx")


@query("ast_decisions", "SELECT decision, assertion, count(*) AS n FROM gold GROUP BY ALL")
def _(spark, sf):
    return _mentions(spark, sf).groupBy("decision", "assertion").agg(F.count("*").alias("n"))


@query("ast_reasons", "SELECT note_id, start_char, CASE WHEN trigger_text IS NULL THEN decision ELSE decision || ': ' || trigger_text END AS assertion_reason FROM gold")
def _(spark, sf):
    return _mentions(spark, sf).select("note_id", "start_char", "assertion_reason")


# -- aggregation, coding, review ---------------------------------------------------------------------------------------
_ENTITIES = """, ent AS (
  SELECT note_id, entity_type, canonical_text, count(*) AS mention_count, min(start_char) AS first_start,
    CASE WHEN count(DISTINCT assertion) = 1 THEN min(assertion) ELSE 'conflicting' END AS assertion FROM gold GROUP BY ALL)"""


@query("agg_rollup", "SELECT note_id, entity_type, canonical_text, assertion, CASE WHEN assertion IN ('conflicting', 'unknown') THEN 'high' ELSE 'routine' END AS review_priority, CAST(mention_count AS INT) AS mention_count, first_start FROM ent", BASE + _ENTITIES)
def _(spark, sf):
    return R.rollup(_mentions(spark, sf)).drop("mentions")


@query("agg_type_assertion", "SELECT entity_type, assertion, count(*) AS n_mentions, count(DISTINCT note_id) AS n_notes FROM gold GROUP BY ALL")
def type_assertion(spark, sf):
    return _mentions(spark, sf).groupBy("entity_type", "assertion").agg(F.count("*").alias("n_mentions"), F.countDistinct("note_id").alias("n_notes"))


@query("agg_grouping_sets", "SELECT entity_type, assertion, CAST(grouping_id(entity_type, assertion) AS INT) AS level, count(*) AS n FROM gold GROUP BY GROUPING SETS ((entity_type), (assertion), (entity_type, assertion), ())")
def _(spark, sf):
    rows = _mentions(spark, sf).select("entity_type", "assertion")
    return spark.sql("SELECT entity_type, assertion, CAST(grouping_id(entity_type, assertion) AS INT) AS level, count(*) AS n FROM {rows} GROUP BY GROUPING SETS ((entity_type), (assertion), (entity_type, assertion), ())", rows=rows)


@query("agg_entity_summary", "SELECT note_id, count(*) AS n_entities, string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) AS by_type FROM (SELECT note_id, entity_type, CAST(count(*) AS STRING) AS n FROM ent GROUP BY ALL) GROUP BY note_id".replace("count(*) AS n_entities", "CAST(sum(CAST(n AS INT)) AS BIGINT) AS n_entities"), BASE + _ENTITIES)
def _(spark, sf):
    by = R.rollup(_mentions(spark, sf)).groupBy("note_id", "entity_type").agg(F.count("*").alias("n"))
    pair = F.array_sort(F.collect_list(F.concat_ws("=", "entity_type", F.col("n").cast("string"))))
    return by.groupBy("note_id").agg(F.sum("n").alias("n_entities"), F.array_join(pair, ",").alias("by_type"))


_CODES = " UNION ALL ".join(f"SELECT {literal(n)} AS name, {literal(t)} AS t, {literal(s)} AS system, {literal(c)} AS code" for n, t, s, c, _, _ in L.STARTER_CODES)


@query("join_codings", f", codes AS ({_CODES}) SELECT note_id, start_char, code, system, FALSE AS is_coded FROM gold LEFT JOIN codes ON name = normalized_text AND t = entity_type")
def _(spark, sf):
    coded = R.code(_mentions(spark, sf), F.col("normalized_text"), spark)
    return coded.select("note_id", "start_char", F.try_element_at("codings", F.lit(1))["code"].alias("code"), F.try_element_at("codings", F.lit(1))["system"].alias("system"), "is_coded")


@query("join_codings_folded", f", codes AS ({_CODES}) SELECT note_id, entity_type, canonical_text, code FROM ent LEFT JOIN codes ON name = canonical_text AND t = entity_type", BASE + _ENTITIES)
def _(spark, sf):
    entities = R.rollup(_mentions(spark, sf))
    return R.code(entities, F.col("canonical_text"), spark).select("note_id", "entity_type", "canonical_text", F.try_element_at("codings", F.lit(1))["code"].alias("code"))


_GATED = """, gated AS (
  SELECT *, CASE WHEN assertion IN ('conflicting', 'unknown') THEN 'blocked' WHEN entity_type = 'risk' AND note_id % 2 = 0 THEN 'flagged' WHEN entity_type = 'risk' THEN 'blocked'
    WHEN entity_type IN ('vital', 'score') THEN 'flagged' ELSE 'blocked' END AS tier FROM ent
), reasoned AS (SELECT *, CASE WHEN assertion = 'conflicting' THEN 'conflicting-assertion' WHEN assertion = 'unknown' THEN 'unknown-assertion'
    WHEN entity_type = 'risk' AND note_id % 2 <> 0 THEN 'reviewer-ack-required' WHEN tier = 'flagged' THEN 'unreviewed' ELSE 'ok' END AS reason FROM gated)"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    acked = F.when(F.col("note_id") % 2 == 0, F.array(F.lit("risk"))).otherwise(F.array().cast("array<string>"))
    return R.gate(R.rollup(_mentions(spark, sf)), acked)


@query("gate_entities", "SELECT note_id, entity_type, canonical_text, tier, reason FROM reasoned", BASE + _ENTITIES + _GATED)
def _(spark, sf):
    return _gated(spark, sf).select("note_id", "entity_type", "canonical_text", "tier", "reason")


@query("gate_documents", "SELECT note_id, count(*) FILTER (tier = 'blocked') AS n_blocked, count(*) AS n_entities, count(*) FILTER (tier = 'blocked') = 0 AS ok FROM reasoned GROUP BY note_id", BASE + _ENTITIES + _GATED)
def _(spark, sf):
    return R.gate_documents(_gated(spark, sf))


_AMBIGUOUS_RE2 = r"(?i)\b(?:" + "|".join(p.replace(" ", r"\s+") for p in L.AMBIGUOUS) + r")\b"
_TRIAGE = f""", least AS (
  SELECT g.note_id, min(CASE WHEN g.text = 'SI' AND NOT regexp_matches(n.text, {literal(_PSYCH_RE2)}) THEN 0.4 WHEN g.entity_type = 'risk' THEN 0.86 ELSE 0.92 END) AS c FROM gold g JOIN notes n USING (note_id) GROUP BY g.note_id
), tri AS (SELECT n.note_id, n.text, concat_ws(',', CASE WHEN regexp_matches(n.text, {literal(_AMBIGUOUS_RE2)}) THEN 'ambiguous_or_reasoning_context' END, CASE WHEN c < 0.75 THEN 'low_confidence_nlp' END,
    CASE WHEN c IS NULL THEN 'no_deterministic_mentions' END) AS reasons FROM notes n LEFT JOIN least USING (note_id))"""


def _triaged(spark: SparkSession, sf: str) -> DataFrame:
    return triage(clinical_notes(spark, sf), _mentions(spark, sf))


@query("ext_triage", "SELECT note_id, reasons <> '' AS requires_llm, reasons FROM tri", BASE + _TRIAGE)
def _(spark, sf):
    return _triaged(spark, sf).select("note_id", "requires_llm", F.array_join("reasons", ",").alias("reasons"))


@query(
    "seg_compressed",
    f""", picked AS (SELECT s.note_id, s.ord, s.text FROM sent s WHERE regexp_matches(s.text, {literal(_AMBIGUOUS_RE2)}) OR EXISTS (SELECT 1 FROM gold g WHERE g.note_id = s.note_id AND contains(s.text, g.text)))
    SELECT t.note_id, CASE WHEN t.reasons = '' THEN '' ELSE coalesce((SELECT string_agg(p.text, chr(10) ORDER BY p.ord) FROM picked p WHERE p.note_id = t.note_id), t.text) END AS compressed_text FROM tri t""",
    BASE + SENTENCES + _TRIAGE,
)
def _(spark, sf):
    return _triaged(spark, sf).select("note_id", "compressed_text")


@query(
    "ext_remap",
    """, llm AS (SELECT n.note_id, n.text, 'Plan: monitor for SI.' AS line FROM notes n WHERE template_id = 15)
    SELECT note_id, CAST(strpos(text, line) - 1 AS INT) AS start_char, CAST(strpos(text, line) + 3 AS INT) AS end_char FROM llm""",
)
def _(spark, sf):
    """A model that saw an excerpt of two lines found the word Plan, and one mention whose text does not come back."""
    notes = clinical_notes(spark, sf).where("template_id = 15").select("note_id", "text", F.lit("Assessment: complex presentation, unclear cause.\nPlan: monitor for SI.").alias("compressed_text"))
    found = F.explode(F.array(*[F.struct(F.lit(t).alias("m_text"), F.lit(s).alias("m_start"), F.lit(e).alias("m_end")) for t, s, e in (("Plan", 49, 53), ("plan", 49, 53), ("SI", 200, 202))]))
    rows = notes.select("*", found.alias("m")).select("note_id", "text", "compressed_text", "m.*")
    return remap_to_source(rows).select("note_id", "start_char", "end_char")


@query(
    "join_merge",
    """SELECT note_id, entity_type, canonical_text, start_char, end_char, 0 AS side FROM gold
    UNION ALL SELECT note_id, entity_type, canonical_text, end_char + 2, end_char + 4, 1 FROM gold WHERE entity_type = 'vital' AND NOT (note_id IN (SELECT note_id FROM notes WHERE template_id = 19) AND canonical_text = 'heart rate' AND gold_ord = 38)""",
)
def _(spark, sf):
    """Secondary mentions: one that overlaps each vital, one two signs behind it, and one that repeats that one's end."""
    m = _mentions(spark, sf).withColumn("canonical_text", R.canonical()).withColumn("idx", F.col("mention_idx").cast("int"))
    vital = m.where("entity_type = 'vital'")
    shifts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in ((0, -1, 1), (1, 2, 4), (2, 3, 5))])).alias("x")
    second = vital.select("note_id", "entity_type", "canonical_text", "end_char", "idx", shifts)
    second = second.select("note_id", "entity_type", "canonical_text", (F.col("end_char") + F.col("x.a")).alias("start_char"), (F.col("end_char") + F.col("x.b")).alias("end_char"), (F.col("idx") * 10 + F.col("x.k")).alias("idx"))
    return merge_mentions(m, second).select("note_id", "entity_type", "canonical_text", "start_char", "end_char", "side")


# -- evaluation --------------------------------------------------------------------------------------------------------
def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Predictions, and gold spans of which some are one or two signs longer and every seventh is of another type."""
    predicted = _mentions(spark, sf).select(F.col("note_id").alias("source_id"), F.col("mention_idx").cast("bigint").alias("idx"), "entity_type", "text", "start_char", "end_char", "assertion")
    gold = gold_mentions(clinical_notes(spark, sf), _events(spark, sf))
    kind = F.when(F.col("gold_ord") % 7 == 3, "problem").otherwise(F.col("entity_type"))
    gold = gold.select(F.col("note_id").alias("source_id"), F.col("gold_ord").cast("bigint").alias("idx"), kind.alias("entity_type"), "text", "start_char", (F.col("end_char") + F.col("gold_ord") % 3).cast("int").alias("end_char"), F.when(F.col("gold_ord") % 5 == 0, "unknown").otherwise(F.col("assertion")).alias("assertion"))
    return predicted, gold


_EVAL = """, p AS (SELECT note_id, entity_type, text, start_char, end_char, assertion, gold_ord FROM gold),
g AS (SELECT note_id, CASE WHEN gold_ord % 7 = 3 THEN 'problem' ELSE entity_type END AS entity_type, start_char, end_char + gold_ord % 3 AS end_char, CASE WHEN gold_ord % 5 = 0 THEN 'unknown' ELSE assertion END AS assertion, gold_ord FROM gold),
pairs AS (SELECT p.note_id, p.entity_type, p.gold_ord, p.assertion AS pa, g.assertion AS ga, (p.end_char - p.start_char) * 1.0 / (g.end_char - g.start_char) AS score, p.end_char = g.end_char AS exact
  FROM p JOIN g ON p.note_id = g.note_id AND p.entity_type = g.entity_type AND p.start_char = g.start_char)"""


@query("evl_pairs", "SELECT note_id, gold_ord, round(score, 6) AS score, exact FROM pairs WHERE score >= 0.5", BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    found = E.greedy_matches(E.candidate_pairs(predicted, gold))
    return found.select(F.col("source_id").alias("note_id"), F.col("g_idx").cast("int").alias("gold_ord"), F.round("score", 6).alias("score"), "exact")


def _prf_sql(where: str, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f""", u AS (SELECT {cols}0 AS m, 1 AS p, 0 AS g FROM p UNION ALL SELECT {cols}0, 0, 1 FROM g UNION ALL SELECT {cols}1, 0, 0 FROM pairs WHERE {where}),
    s AS (SELECT {cols}sum(m) AS m, sum(p) AS p, sum(g) AS g FROM u {group}), r AS (SELECT *, m * 1.0 / nullif(p, 0) AS pr, m * 1.0 / nullif(g, 0) AS re FROM s)
    SELECT {cols}CAST(m AS BIGINT) AS true_positive, CAST(greatest(0, p - m) AS BIGINT) AS false_positive, CAST(greatest(0, g - m) AS BIGINT) AS false_negative, round(pr, 6) AS precision, round(re, 6) AS recall,
    round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM r"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("evl_exact", _prf_sql("exact"), BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    return _rounded(E.metrics(predicted, gold, E.greedy_matches(E.candidate_pairs(predicted, gold, 1.0, exact_only=True))))


@query("evl_partial", _prf_sql("score >= 0.5"), BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    return _rounded(E.metrics(predicted, gold, E.greedy_matches(E.candidate_pairs(predicted, gold))))


@query("evl_by_type", _prf_sql("score >= 0.5", "entity_type"), BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    return _rounded(E.metrics(predicted, gold, E.greedy_matches(E.candidate_pairs(predicted, gold)), by=["entity_type"]))


@query("evl_attribute", "SELECT 'assertion' AS attribute, count(*) FILTER (pa = ga) AS correct, count(*) AS total, round(count(*) FILTER (pa = ga) * 1.0 / count(*), 6) AS accuracy FROM pairs WHERE score >= 0.5", BASE + _EVAL)
def _(spark, sf):
    predicted, gold = _sides(spark, sf)
    out = E.attribute_accuracy(predicted, gold, E.greedy_matches(E.candidate_pairs(predicted, gold)))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("evl_type_overlap", "SELECT note_id, gold_ord, round(score, 6) AS char_score, CAST(1.0 AS DOUBLE) AS token_score FROM pairs", BASE + _EVAL)
def _(spark, sf):
    from chartloom.functions.spans import char_jaccard, token_jaccard

    predicted, gold = _sides(spark, sf)
    p = predicted.select("source_id", "entity_type", "start_char", F.col("end_char").alias("pe"), F.col("text").alias("pt"))
    rows = p.join(gold, ["source_id", "entity_type", "start_char"])
    c = char_jaccard(F.col("start_char"), F.col("pe"), F.col("start_char"), F.col("end_char"))
    return rows.select(F.col("source_id").alias("note_id"), F.col("idx").cast("int").alias("gold_ord"), F.round(c, 6).alias("char_score"), token_jaccard(F.col("pt"), F.col("text")).alias("token_score"))


# -- features and risk -------------------------------------------------------------------------------------------------
_VALUES = r""", v AS (SELECT *, TRY_CAST(CASE WHEN canonical_text IN ('heart rate', 'phq-9') THEN regexp_extract(text, '(\d+)$', 1) WHEN canonical_text = 'pain rating' THEN regexp_extract(text, '(\d+)/10', 1) END AS DOUBLE) AS value,
  TRY_CAST(CASE WHEN canonical_text = 'blood pressure' THEN regexp_extract(text, '(\d+)/', 1) END AS DOUBLE) AS systolic, TRY_CAST(CASE WHEN canonical_text = 'blood pressure' THEN regexp_extract(text, '/(\d+)', 1) END AS DOUBLE) AS diastolic FROM gold)"""


def _spec_sql() -> str:
    out = []
    for s in X.DEFAULT_SPECS:
        mine = f"w.entity_type = {literal(s.entity_type)} AND w.canonical_text = {literal((s.normalized_text or '').lower())} AND w.observed_at >= n.observed_at - INTERVAL {s.lookback_days} DAY"
        here = f"({mine} AND w.assertion = 'present')"
        number = f"CASE WHEN {here} THEN w.value END"
        out += [
            f"count(*) FILTER ({here}) AS {s.name}__present_count", f"count(*) FILTER ({mine} AND w.assertion = 'absent') AS {s.name}__absent_count", f"count(*) FILTER ({mine} AND w.assertion IN ('possible', 'hypothetical')) AS {s.name}__possible_count",
            f"arg_max(w.value, (w.observed_at, w.note_id, w.start_char)) FILTER ({here} AND w.value IS NOT NULL) AS {s.name}__last",
            f"min({number}) AS {s.name}__min", f"max({number}) AS {s.name}__max", f"round(avg({number}), 6) AS {s.name}__mean",
            f"count(*) FILTER ({mine}) = 0 AS {s.name}__missing", f"(count(*) FILTER ({mine} AND w.assertion = 'absent') > 0 AND count(*) FILTER ({here}) = 0) AS {s.name}__explicitly_negated",
        ]
    return ", ".join(out)


@query("ftr_matrix", f"SELECT n.patient_id, n.visit_id, {_spec_sql()} FROM notes n LEFT JOIN v w ON w.patient_id = n.patient_id AND w.observed_at < n.observed_at AND w.observed_at >= n.observed_at - INTERVAL 365 DAY GROUP BY n.patient_id, n.visit_id", BASE + _VALUES)
def _(spark, sf):
    notes = clinical_notes(spark, sf)
    records = _mentions(spark, sf, "patient_id", "observed_at").withColumn("ord", F.struct("note_id", "start_char"))
    index = notes.select("patient_id", "visit_id", F.col("observed_at").alias("prediction_time"))
    out = X.feature_matrix(records, index).drop("prediction_time")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("__mean")})


_RISK = (
    _VALUES
    + """, rf0 AS (SELECT note_id, CAST(count(*) AS DOUBLE) AS entity_count, CAST(count(*) FILTER (entity_type = 'risk' AND assertion <> 'absent') AS DOUBLE) AS problem_count_present,
  CAST(count(*) FILTER (assertion = 'unknown') AS DOUBLE) AS high_priority_count, arg_max(value, start_char) FILTER (canonical_text = 'pain rating' AND assertion <> 'absent') AS pain,
  avg(value) FILTER (canonical_text = 'heart rate') AS hr, max(systolic) AS sys, max(diastolic) AS dia, max(value) FILTER (canonical_text = 'phq-9') AS phq,
  CAST(max(CASE WHEN entity_type = 'risk' AND assertion <> 'absent' THEN 1 ELSE 0 END) AS DOUBLE) AS si__present, CAST(max(CASE WHEN entity_type = 'risk' AND assertion = 'absent' THEN 1 ELSE 0 END) AS DOUBLE) AS si__explicitly_negated FROM v GROUP BY note_id),
rf AS (SELECT note_id, entity_count, problem_count_present, 0.0 AS medication_count, 0.0 AS plan_count, 0.0 AS functional_limitation_count, high_priority_count, coalesce(pain, 0) AS pain_rating__last, CASE WHEN pain IS NULL THEN 1.0 ELSE 0.0 END AS pain_rating__missing,
  round(coalesce(hr, 0), 1) AS heart_rate__mean, CASE WHEN hr IS NULL THEN 1.0 ELSE 0.0 END AS heart_rate__missing, coalesce(sys, 0) AS bp_systolic__last, coalesce(dia, 0) AS bp_diastolic__last, CASE WHEN sys IS NULL THEN 1.0 ELSE 0.0 END AS bp_missing,
  coalesce(phq, 0) AS phq9__max, CASE WHEN phq IS NULL THEN 1.0 ELSE 0.0 END AS phq9__missing, 0.0 AS gad7__max, si__present, si__explicitly_negated FROM rf0)"""
)
_NAMES = [n for n, *_ in L.RISK_FEATURES]


@query("rsk_features", "SELECT note_id, " + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _NAMES) + " FROM rf", BASE + _RISK)
def _(spark, sf):
    return X.risk_features(_mentions(spark, sf))


def _term(name: str, weight: float, center: float, scale: float) -> str:
    value = f"CASE WHEN heart_rate__missing = 1 THEN {center} ELSE {name} END" if name == "heart_rate__mean" else f"CASE WHEN bp_missing = 1 THEN {center} ELSE {name} END" if name in ("bp_systolic__last", "bp_diastolic__last") else name
    return f"CAST(({value}) AS DOUBLE) / CAST({scale} AS DOUBLE) * CAST({weight} AS DOUBLE)" if center == 0 else f"(CAST(({value}) AS DOUBLE) - CAST({center} AS DOUBLE)) / CAST({scale} AS DOUBLE) * CAST({weight} AS DOUBLE)"


_SCORED = _RISK + f", sc AS (SELECT note_id, round(1 / (1 + exp(-(CAST({L.RISK_INTERCEPT} AS DOUBLE) + " + " + ".join(_term(*x) for x in L.RISK_FEATURES) + "))), 3) AS probability FROM rf)"


@query("rsk_scores", "SELECT note_id, probability, CASE WHEN probability >= 0.65 THEN 'high' WHEN probability >= 0.35 THEN 'moderate' ELSE 'low' END AS band, CASE WHEN probability >= 0.5 THEN 'above-threshold' ELSE 'below-threshold' END AS decision FROM sc", BASE + _SCORED)
def _(spark, sf):
    return X.risk_score(X.risk_features(_mentions(spark, sf))).select("note_id", "probability", "band", "decision")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    scored = X.risk_score(X.risk_features(_mentions(spark, sf)))
    return scored.select(F.col("note_id").alias("ord"), F.when((F.col("note_id") * 7) % 11 < 4, 1).otherwise(0).alias("y_true"), F.col("probability").alias("y_score"), F.when(F.col("note_id") % 3 == 0, "nlp").when(F.col("note_id") % 3 == 1, "llm").otherwise("hybrid").alias("mode"))


_LABELLED = _SCORED + ", lab AS (SELECT note_id AS ord, CASE WHEN (note_id * 7) % 11 < 4 THEN 1 ELSE 0 END AS y, probability AS s, CASE note_id % 3 WHEN 0 THEN 'nlp' WHEN 1 THEN 'llm' ELSE 'hybrid' END AS mode FROM sc)"


@query("agg_roc_auc", ", h AS (SELECT mode, s, sum(y) AS p, count(*) - sum(y) AS q FROM lab GROUP BY ALL) SELECT a.mode, round(sum(a.p * b.q * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / (sum(a.p * b.q)), 6) AS roc_auc FROM h a JOIN h b ON a.mode = b.mode GROUP BY a.mode", BASE + _LABELLED)
def _(spark, sf):
    return E.roc_auc(_labelled(spark, sf), by=["mode"]).withColumn("roc_auc", F.round("roc_auc", 6))


@query("agg_average_precision", ", r AS (SELECT mode, y, sum(y) OVER w * 1.0 / row_number() OVER w AS pr FROM lab WINDOW w AS (PARTITION BY mode ORDER BY s DESC, ord ROWS UNBOUNDED PRECEDING)) SELECT mode, round(avg(pr) FILTER (y = 1), 6) AS average_precision FROM r GROUP BY mode", BASE + _LABELLED)
def _(spark, sf):
    return E.average_precision(_labelled(spark, sf), by=["mode"]).withColumn("average_precision", F.round("average_precision", 6))


@query(
    "agg_classifier_report",
    """, own AS (SELECT mode, y, s, ord FROM lab UNION ALL SELECT 'negatives', y, s, ord FROM lab WHERE mode = 'nlp' AND y = 0 UNION ALL SELECT 'positives', y, s, ord FROM lab WHERE mode = 'nlp' AND y = 1),
    h AS (SELECT mode, s, sum(y) AS p, count(*) - sum(y) AS q FROM own GROUP BY ALL),
    auc AS (SELECT a.mode, sum(a.p * b.q * CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / nullif(sum(a.p * b.q), 0) AS roc_auc FROM h a JOIN h b ON a.mode = b.mode GROUP BY a.mode),
    r AS (SELECT mode, y, sum(y) OVER w * 1.0 / row_number() OVER w AS pr FROM own WINDOW w AS (PARTITION BY mode ORDER BY s DESC, ord ROWS UNBOUNDED PRECEDING))
    SELECT mode, count(*) AS sample_count, count(*) FILTER (y = 1) AS positive_count, count(*) FILTER (y = 0) AS negative_count, round(any_value(roc_auc), 6) AS roc_auc, round(avg(pr) FILTER (y = 1), 6) AS average_precision FROM r LEFT JOIN auc USING (mode) GROUP BY mode""",
    BASE + _LABELLED,
)
def _(spark, sf):
    """By mode, and over rows of one class only, where a figure is not defined."""
    rows = _labelled(spark, sf)
    for mode, y in (("negatives", 0), ("positives", 1)):
        rows = rows.unionByName(_labelled(spark, sf).where((F.col("mode") == "nlp") & (F.col("y_true") == y)).withColumn("mode", F.lit(mode)))
    return E.classifier_report(rows, ["mode"]).withColumns({c: F.round(c, 6) for c in ("roc_auc", "average_precision")})


@query("agg_binary_report", """, c AS (SELECT mode, count(*) AS n, count(*) FILTER (y = 1) AS positives, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y = 0) AS fp, count(*) FILTER (s < 0.5 AND y = 0) AS tn, count(*) FILTER (s < 0.5 AND y = 1) AS fn, round(avg((s - y) * (s - y)), 6) AS brier FROM lab GROUP BY mode)
  SELECT mode, n, positives, tp, fp, tn, fn, brier, round((tp + tn) * 1.0 / n, 6) AS accuracy, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""", BASE + _LABELLED)
def _(spark, sf):
    return E.binary_report(_labelled(spark, sf), by=["mode"]).withColumns({c: F.round(c, 6) for c in ("brier", "accuracy", "precision", "recall", "f1")})


# -- validators --------------------------------------------------------------------------------------------------------
_KINDS = [*V.VITAL_RANGES, "temperature"]


@query("val_vitals", "WITH x AS (SELECT event_id, CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {literal(n)}" for k, n in enumerate(_KINDS)) + " END AS kind, CAST(event_id % 331 AS DOUBLE) AS value, CASE event_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'degF' END AS unit FROM events) SELECT event_id, kind, CASE kind " + " ".join(f"WHEN {literal(n)} THEN value BETWEEN {a} AND {b}" for n, (a, b) in V.VITAL_RANGES.items()) + " ELSE CASE WHEN unit = 'C' THEN value BETWEEN 25 AND 45 ELSE value BETWEEN 77 AND 113 END END AS is_valid FROM x", "")
def _(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 7 + 1).cast("int"))
    unit = F.when(F.col("event_id") % 3 == 0, "C").when(F.col("event_id") % 3 == 1, "degF")
    rows = _events(spark, sf).select("event_id", kind.alias("kind"), (F.col("event_id") % 331).cast("double").alias("value"), unit.alias("unit"))
    return rows.select("event_id", "kind", V.vital_ok(F.col("kind"), F.col("value"), F.col("unit")).alias("is_valid"))


@query("val_blood_pressure", "SELECT event_id, (event_id % 351 BETWEEN 40 AND 300 AND event_id % 213 BETWEEN 20 AND 200 AND event_id % 351 > event_id % 213) AS is_valid FROM events", "")
def _(spark, sf):
    return _events(spark, sf).select("event_id", V.blood_pressure_ok(F.col("event_id") % 351, F.col("event_id") % 213).alias("is_valid"))


@query("val_labs", "SELECT event_id, (event_id % 5 <> 0 AND (event_id % 101 < event_id % 103) AND (event_id % 7 >= 3 OR event_id % 2 = 0)) AS is_valid FROM events", "")
def _(spark, sf):
    name = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 2 == 0, "Base Excess").otherwise("sodium")
    value = (F.col("event_id") % 7 - 3).cast("double")
    return _events(spark, sf).select("event_id", V.lab_ok(name, value, F.col("event_id") % 101, F.col("event_id") % 103).alias("is_valid"))


@query("val_scores", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 37 <= 27 WHEN 1 THEN event_id % 37 <= 21 WHEN 2 THEN event_id % 37 <= 12 ELSE TRUE END AS is_valid FROM events", "")
def _(spark, sf):
    scale = F.element_at(F.array(*[F.lit(x) for x in ("PHQ-9", " gad_7", "AUDIT-C", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return _events(spark, sf).select("event_id", V.score_ok(scale, F.col("event_id") % 37).alias("is_valid"))


@query("val_strength", "SELECT event_id, CASE WHEN event_id % 6 = 5 AND event_id % 3 = 0 THEN NULL WHEN event_id % 6 = 0 AND event_id % 3 = 1 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE round(event_id % 6 + CASE event_id % 3 WHEN 0 THEN 0.3 WHEN 1 THEN -0.3 ELSE 0 END, 6) END AS grade FROM events", "")
def _(spark, sf):
    sign = F.when(F.col("event_id") % 3 == 0, "+").when(F.col("event_id") % 3 == 1, "-").otherwise("")
    raw = F.when(F.col("event_id") % 11 == 0, "strong").otherwise(F.concat((F.col("event_id") % 6).cast("string"), sign, F.lit(" /5")))
    return _events(spark, sf).select("event_id", F.round(V.strength_grade(raw), 6).alias("grade"))


@query("val_pain_motion", "SELECT event_id, event_id % 13 <= 10 AS pain_valid, (event_id % 2 = 0 AND event_id % 400 <= 360) AS motion_valid FROM events", "")
def _(spark, sf):
    movement = F.when(F.col("event_id") % 2 == 0, "flexion").otherwise("  ")
    return _events(spark, sf).select("event_id", V.pain_ok(F.col("event_id") % 13).alias("pain_valid"), V.motion_ok(movement, F.col("event_id") % 400).alias("motion_valid"))


# -- sessions ----------------------------------------------------------------------------------------------------------
@query("src_latest_session", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1", "")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf).withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_id", "event_type")


# -- rules that the note templates do not reach -------------------------------------------------------------------------
CHRONIC_CONCEPTS = (L.Concept("problem", r"(?i)\b(?:hypertension|asthma)\b", "hypertension"), L.Concept("finding", r"(?i)\bgait\b", "gait"))
_CHRONIC_TEXTS = ("History of hypertension, on lisinopril.", "History of hypertension.", "History of hypertension, seen on admission.", "Gait steady today.", "No history of hypertension, on lisinopril.")


@query(
    "ast_chronic_active",
    """WITH x AS (SELECT event_id, event_id % 5 AS k FROM events) SELECT event_id AS note_id, CASE k WHEN 0 THEN 'present' WHEN 3 THEN 'present' WHEN 4 THEN 'absent' ELSE 'historical' END AS assertion,
    CASE k WHEN 0 THEN 'chronic-active-present: History of' WHEN 3 THEN 'default-present' WHEN 4 THEN 'pre-negation: No history of' ELSE 'historical: History of' END AS assertion_reason FROM x""",
    "",
)
def _(spark, sf):
    text = F.element_at(F.array(*[F.lit(t) for t in _CHRONIC_TEXTS]), (F.col("event_id") % 5 + 1).cast("int"))
    notes = _events(spark, sf).select(F.col("event_id").alias("note_id"), text.alias("text"))
    return extract_mentions(notes, CHRONIC_CONCEPTS).select("note_id", "assertion", "assertion_reason")


@query(
    "ast_incoming",
    "WITH x AS (SELECT event_id, event_id % 3 AS i, event_id % 2 AS n FROM events) SELECT event_id, CASE WHEN n = 1 THEN 'absent' WHEN i = 0 THEN 'unknown' WHEN i = 1 THEN 'planned' ELSE 'present' END AS assertion, CASE WHEN n = 1 THEN 'pre-negation' WHEN i = 0 THEN 'unresolved' ELSE 'default-present' END AS decision FROM x",
    "",
)
def _(spark, sf):
    """Mentions that bring an assertion along: it stays where nothing in the sentence speaks against it."""
    from chartloom.operators.assertion import resolve

    given = F.when(F.col("event_id") % 3 == 0, "unknown").when(F.col("event_id") % 3 == 1, "planned").otherwise("present")
    rows = _events(spark, sf).select("event_id", F.lit("gait").alias("text"), F.lit("gait").alias("normalized_text"), given.alias("assertion"), F.when(F.col("event_id") % 2 == 1, "No ").otherwise("The ").alias("before"), F.lit(" steady today.").alias("after"))
    return resolve(rows).select("event_id", "assertion", "decision")


def _term_number(name: str, weight: float, center: float, scale: float) -> str:
    return f"(CASE WHEN {_term(name, weight, center, scale)} IS NULL THEN 0.0 ELSE {_term(name, weight, center, scale)} END)"


_DRIVERS = _RISK + ", dr0 AS (" + " UNION ALL ".join(f"SELECT note_id, {k} AS ord, {literal(n)} AS feature, {_term_number(n, w, c, s)} AS v FROM rf" for k, (n, w, c, s) in enumerate(L.RISK_FEATURES)) + """),
  dr AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY -abs(v), ord) AS k FROM dr0 WHERE abs(v) >= 0.08)"""


@query("rsk_drivers", "SELECT n.note_id, coalesce(string_agg(feature || ' ' || printf('%+.2f', v), '; ' ORDER BY k) FILTER (k <= 5), 'No elevated model drivers from extracted features') AS drivers FROM rf n LEFT JOIN dr USING (note_id) GROUP BY n.note_id", BASE + _DRIVERS)
def _(spark, sf):
    return X.risk_score(X.risk_features(_mentions(spark, sf))).select("note_id", "drivers")
