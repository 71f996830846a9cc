"""Queries over what is kept or learned: training, the session log, sessions at work, requests once, expansion pages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import lexicon as L
from chartloom.operators.adapters import search_codes
from chartloom.operators.features import risk_features
from chartloom.operators.lineage import cut_lineage, shared_folder
from chartloom.operators.session_log import SessionLog
from chartloom.operators.training import EPOCHS, train_risk, training_report
from chartloom.plans.catalog import _RISK, BASE, _events, _mentions, _term, query
from chartloom.sources.expansions import read_expansions, record_expansions
from chartloom.sources.notes import clinical_notes
from chartloom.sources.quarantine import read_records, sorted_out
from chartloom.streaming.mentions import requests_once, session_periods

_EPOCHS, _RATE, _RIDGE = 12, 0.15, 0.015
_X = "[" + ", ".join(_term(n, 1.0, c, s) for n, _, c, s in L.RISK_FEATURES) + "]"
_STEP = ", ".join(f"any_value(w)[{k}] - {_RATE} * (avg(e * x[{k}]) + {_RIDGE} * any_value(w)[{k}])" for k in range(1, len(L.RISK_FEATURES) + 1))


def _trained(epochs: int) -> str:
    return f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}{_RISK}, cases AS MATERIALIZED (SELECT {_X} AS x, CASE WHEN (note_id * 7) % 11 < 4 THEN 1 ELSE 0 END AS y FROM rf),
step AS (SELECT 0 AS epoch, CAST(0 AS DOUBLE) AS b, list_transform(range({len(L.RISK_FEATURES)}), lambda i: CAST(0 AS DOUBLE)) AS w
  UNION ALL SELECT epoch + 1, any_value(b) - {_RATE} * avg(e), [{_STEP}]
  FROM (SELECT epoch, b, w, x, 1 / (1 + exp(-(b + list_dot_product(w, x)))) - y AS e FROM step, cases WHERE epoch < {epochs}) GROUP BY epoch),
model AS (SELECT b, w FROM step WHERE epoch = {epochs})"""


def _cases(spark, sf):
    features = risk_features(_mentions(spark, sf))
    return features.withColumn("label", F.when((F.col("note_id") * 7) % 11 < 4, 1).otherwise(0))


_NAMES = ", ".join(f"'{n}'" for n, *_ in L.RISK_FEATURES)


@query("rsk_trained", f"SELECT unnest(['intercept', {_NAMES}]) AS feature, round(unnest(list_concat([b], w)), 6) AS weight FROM model", _trained(_EPOCHS))
def _(spark, sf):
    """The risk model trained on all notes, for a few epochs."""
    model = train_risk(_cases(spark, sf), _EPOCHS, _RATE, _RIDGE)
    return spark.createDataFrame([("intercept", round(model.intercept, 6)), *[(n, round(w, 6)) for n, w, *_ in model.features]], "feature string, weight double")


@query(
    "rsk_training_report",
    """, said AS (SELECT 1 / (1 + exp(-(b + list_dot_product(w, x)))) >= 0.5 AS p, y = 1 AS t FROM cases, model),
  c AS (SELECT count(*) AS n, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM said)
  SELECT n, CASE WHEN n = 0 THEN 0 ELSE (tp + tn) / n END AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c""",
    _trained(EPOCHS),
)
def _(spark, sf):
    """The report of a whole training."""
    cases = cut_lineage(_cases(spark, sf))  # read by the training and by the report
    return training_report(cases, train_risk(cases, EPOCHS, _RATE, _RIDGE))


_SAVED = """, ops AS (
  SELECT 1 AS k, 's' || note_id AS session_id, 'save' AS op, observed_at AS saved_at, text FROM notes
  UNION ALL SELECT 2, 's' || note_id, 'save', observed_at + INTERVAL 1 DAY, 'Edited. ' || text FROM notes WHERE note_id % 3 = 0
  UNION ALL SELECT 3, 's' || note_id, 'delete', NULL, NULL FROM notes WHERE note_id % 5 = 0
  UNION ALL SELECT 4, 's' || note_id, 'save', observed_at - INTERVAL 1 DAY, 'Again. ' || text FROM notes WHERE note_id % 15 = 0
  UNION ALL SELECT 5, 'i' || note_id, 'save', observed_at, text FROM notes WHERE note_id % 7 = 0 AND note_id % 2 = 1),
last AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY k DESC) = 1)
SELECT session_id, saved_at, CASE WHEN length(l) > 64 THEN l[1:61] || '...' ELSE l END AS name, text FROM (SELECT *, trim(string_split(text, chr(10))[1]) AS l FROM last WHERE op = 'save')"""


@query("src_session_log", _SAVED)
def _(spark, sf):
    """All notes saved as sessions, some again, some deleted and saved once more, and some imported, every second with a fault;
    a snapshot in between."""
    notes = clinical_notes(spark, sf)
    log = SessionLog(spark)

    def rows(keep, text, days):
        return notes.where(keep).select(F.concat(F.lit("s"), "note_id").alias("session_id"), (F.col("observed_at") + F.expr(f"INTERVAL {days} DAY")).alias("saved_at"), text.alias("text"), text.alias("session"))

    log.save(rows("true", F.col("text"), 0))
    log.save(rows("note_id % 3 = 0", F.concat(F.lit("Edited. "), "text"), 1))
    log.delete(rows("note_id % 5 = 0", F.col("text"), 0))
    log.snapshot()
    log.save(rows("note_id % 15 = 0", F.concat(F.lit("Again. "), "text"), -1))
    specialty = F.when(F.col("note_id") % 2 == 0, "none of them").otherwise("mixed")
    raw = F.to_json(F.struct(F.lit("prototype-1").alias("schemaVersion"), specialty.alias("specialty"), F.col("text").alias("sourceText"), F.array().cast("array<string>").alias("entities")))
    log.take_in(notes.where("note_id % 7 = 0").select(F.concat(F.lit("i"), "note_id").alias("session_id"), F.col("observed_at").alias("saved_at"), raw.alias("raw")))
    return log.sessions().select("session_id", "saved_at", "name", F.when(F.col("session_id").startswith("i"), F.get_json_object("session", "$.sourceText")).otherwise(F.col("session")).alias("text"))


def _requests(spark, sf):
    return _events(spark, sf).select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.col("ts").alias("at"))


@query(
    "str_session_periods",
    """WITH r AS (SELECT user_id, event_id, event_type, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM r)
    SELECT CAST(user_id AS VARCHAR) AS session_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, max(event_id) AS seq, arg_max(event_type, event_id) AS text, count(*) AS n_requests FROM p GROUP BY user_id, k""",
    "",
)
def _(spark, sf):
    return session_periods(_requests(spark, sf))


@query("svc_requests_once", "SELECT CAST(user_id % 50 AS VARCHAR) || event_type AS id, min(ts) AS at, arg_min(event_id, (ts, event_id)) AS seq FROM events GROUP BY 1", "")
def _(spark, sf):
    """Requests whose ids come again and again."""
    rows = _requests(spark, sf).select(F.concat((F.col("session_id").cast("bigint") % 50).cast("string"), "text").alias("id"), "at", "seq")
    return requests_once(rows)


_WORDS = ("ab", "CH", "ing", "4", "ste", "1 2")
_ASKED = " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WORDS))


@query(
    "trm_recorded_search",
    f"""WITH c AS (SELECT p_name AS name, CAST(p_partkey AS VARCHAR) AS code, p_name || ' ' || p_brand AS display FROM part WHERE p_partkey % 3 = 1),
    q AS (SELECT event_id AS query_id, CASE event_id % {len(_WORDS)} {_ASKED} END AS f FROM events WHERE event_id % 3 <> 1),
    w AS (SELECT f, name, code, display, row_number() OVER (PARTITION BY f ORDER BY display, code) AS rank FROM (SELECT DISTINCT f FROM q) JOIN c ON contains(lower(display || ' ' || code || ' ' || display), lower(f)))
    SELECT query_id, CAST(rank AS INT) AS rank, code, display FROM q JOIN w USING (f) WHERE rank <= 3""",
    "",
)
def _(spark, sf):
    """Parts recorded as the expansions of three systems, of which one is searched."""
    at = F.row_number().over(Window.partitionBy("system", "bin").orderBy("p_partkey")) - 1
    systems = F.when(F.col("p_partkey") % 3 == 0, "CPT").when(F.col("p_partkey") % 3 == 1, "LOINC").otherwise("RxNorm")
    parts = spark.read.parquet(f"{sf}/part.parquet").withColumn("system", systems).withColumn("bin", F.floor(F.col("p_partkey") / 1000))
    folder = shared_folder(spark, "expansions")
    record_expansions(parts.select("system", (F.col("bin") * 1000 + at).alias("ord"), F.col("p_partkey").cast("string").alias("code"), F.concat_ws(" ", "p_name", "p_brand").alias("display")), folder)
    codes = read_expansions(spark, folder).where("system = 'LOINC'").select(F.col("display").alias("name"), "system", "code", "display")
    asked = F.lit(None).cast("string")
    for k, w in enumerate(_WORDS):
        asked = F.when(F.col("event_id") % len(_WORDS) == k, w).otherwise(asked)
    queries = _events(spark, sf).where("event_id % 3 <> 1").select(F.col("event_id").alias("query_id"), asked.alias("filter"))
    found = search_codes(codes, queries.select("filter").distinct().withColumn("query_id", F.col("filter")), 3)
    return queries.join(found.withColumnRenamed("query_id", "filter"), "filter").select("query_id", "rank", "code", "display")


@query(
    "src_quarantine",
    """, r AS (SELECT note_id, CASE note_id % 9 WHEN 0 THEN 'the line is not JSON' WHEN 1 THEN 'the record is no object' WHEN 2 THEN 'text is missing' WHEN 3 THEN 'mention 0 has a span that does not reproduce its text' END AS reason FROM notes)
    SELECT r.note_id % 22 AS template_id, reason, count(*) AS n, CAST(sum(CASE WHEN reason IS NULL THEN length(n.text) ELSE 0 END) AS BIGINT) AS chars FROM r JOIN notes n USING (note_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    """All notes written as JSON Lines with their first sign as a mention, four in nine with a fault; what is read back, of both outputs."""
    kind = F.col("note_id") % 9
    mention = F.struct(F.substring("text", 1, 1).alias("text"), F.lit("other").alias("entity_type"), F.when(kind == 3, 1).otherwise(0).alias("start_char"), F.when(kind == 3, 3).otherwise(1).alias("end_char"), F.lit("present").alias("assertion"))
    whole = F.to_json(F.struct(F.col("note_id").cast("string").alias("source_id"), F.when(kind != 2, F.col("text")).alias("text"), F.array(mention).alias("mentions")))
    raw = F.when(kind == 0, F.concat(F.lit("{ no json "), "note_id")).when(kind == 1, F.concat(F.lit("["), "note_id", F.lit("]"))).otherwise(whole)
    folder = shared_folder(spark, "records")
    clinical_notes(spark, sf).select(raw.alias("value")).write.text(folder)
    notes, bad = sorted_out(read_records(spark, folder))
    number = F.regexp_extract("raw", r"(\d+)", 1).cast("bigint")
    both = notes.select(F.col("source_id").cast("bigint").alias("note_id"), F.lit(None).cast("string").alias("reason"), F.length("text").alias("chars"))
    both = both.unionByName(bad.select(number.alias("note_id"), "reason", F.lit(0).alias("chars")))
    return both.groupBy((F.col("note_id") % 22).alias("template_id"), "reason").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
