"""Gated export: what leaves the system, as JSON, as a bundle or as clipboard text, and the acknowledgments that let it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.operators.documents import latest
from chartloom.operators.rollup import ACK_REQUIRED

# The order in which entity types are shown.
DISPLAY_ORDER = ("problem", "symptom", "medication", "allergy", "vital", "lab", "score", "severity", "risk", "procedure", "imaging", "exercise", "referral", "plan")


def acknowledgments(log: DataFrame) -> DataFrame:
    """log(session_id, reviewer_id, types, at) -> (session_id, entity_type, reviewer_id, at): the newest of each type.

    A row without a reviewer, or without a type that needs acknowledging, is refused: see refused_acknowledgments.
    """
    rows = log.where(F.trim(F.coalesce("reviewer_id", F.lit(""))) != "").select("session_id", F.trim("reviewer_id").alias("reviewer_id"), "at", F.explode("types").alias("entity_type"))
    return latest(rows.where(F.col("entity_type").isin(*ACK_REQUIRED)), ["session_id", "entity_type"], [F.desc("at"), F.asc("reviewer_id")]).select("session_id", "entity_type", "reviewer_id", "at")


def refused_acknowledgments(log: DataFrame) -> DataFrame:
    """The rows of the log that acknowledge nothing."""
    blank = F.trim(F.coalesce("reviewer_id", F.lit(""))) == ""
    return log.where(blank | ~F.coalesce(F.exists("types", lambda t: t.isin(*ACK_REQUIRED)), F.lit(False)))


def acknowledged_types(acks: DataFrame) -> DataFrame:
    """(session_id, acknowledged): the acknowledged types of a session as an array."""
    return acks.groupBy("session_id").agg(F.array_sort(F.collect_set("entity_type")).alias("acknowledged"))


def serializable(gated: DataFrame) -> DataFrame:
    """The entities that may leave, marked reviewed or unreviewed."""
    return gated.where("tier <> 'blocked'").withColumn("review_status", F.when(F.col("tier") == "flagged", "unreviewed").otherwise("reviewed"))


def blocked(gated: DataFrame) -> DataFrame:
    return gated.where("tier = 'blocked'").drop("tier")


def export_type_of(kind: Column) -> Column:
    """The resource an entity becomes in a gated export."""
    return F.when(kind == "medication", "MedicationStatement").when(kind == "allergy", "AllergyIntolerance").when(kind.isin("vital", "score"), "Observation").otherwise("Condition")


def exports(gated: DataFrame, export_type: str) -> DataFrame:
    """gated(session_id, ord, id, entity_type, canonical_text, display_name, tier, reason) -> (session_id, status, payload).

    A session with one blocked entity has status 409 and the list of what is blocked, and nothing of the rest.  export_type:
    json, fhir or clipboard; any other is json.  Entities stand in the order of ord.
    """
    kind = export_type if export_type in ("fhir", "clipboard") else "json"
    review = F.when(F.col("tier") == "flagged", "unreviewed").otherwise("reviewed")
    stopped = F.struct(F.col("id"), F.col("entity_type").alias("type"), F.col("canonical_text").alias("canonicalName"), F.col("reason"))
    if kind == "fhir":
        verified = F.when(review == "unreviewed", "unconfirmed").otherwise("confirmed")
        one = F.to_json(F.struct(F.struct(export_type_of(F.col("entity_type")).alias("resourceType"), F.struct(F.col("canonical_text").alias("text")).alias("code"), verified.alias("verificationStatus"), F.lit("machine-extracted").alias("provenance")).alias("resource")))
    elif kind == "clipboard":
        one = F.concat("display_name", F.lit(" ("), "entity_type", F.lit("; "), review, F.lit(")"))
    else:
        one = F.to_json(F.struct(F.col("id"), F.col("canonical_text").alias("canonicalName"), F.col("display_name").alias("displayName"), F.col("entity_type").alias("type"), review.alias("reviewStatus")))
    rows = gated.select("session_id", "ord", F.col("tier") == "blocked", F.to_json(stopped).alias("stopped"), one.alias("one")).toDF("session_id", "ord", "is_blocked", "stopped", "one")
    listed = lambda c, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", c)))), lambda x: x[c])
    out = rows.groupBy("session_id").agg(listed("stopped", F.col("is_blocked")).alias("stopped"), listed("one", ~F.col("is_blocked")).alias("free"))
    joined = F.array_join("free", "\n" if kind == "clipboard" else ",")
    if kind == "fhir":
        body = F.concat(F.lit('{"exportType":"fhir","resourceType":"Bundle","type":"collection","entry":['), joined, F.lit("]}"))
    elif kind == "clipboard":
        body = F.to_json(F.struct(F.lit("clipboard").alias("exportType"), joined.alias("text")))
    else:
        body = F.concat(F.lit('{"exportType":"json","schemaVersion":"prototype-1","sessionId":"'), F.col("session_id").cast("string"), F.lit('","entities":['), joined, F.lit("]}"))
    refusal = F.concat(F.lit('{"error":"export-blocked","blocked":['), F.array_join("stopped", ","), F.lit(f'],"exportType":"{export_type}"}}'))
    some = F.size("stopped") > 0
    return out.select("session_id", F.when(some, 409).otherwise(200).alias("status"), F.when(some, refusal).otherwise(body).alias("payload"))


def clipboard_summary(entities: DataFrame) -> DataFrame:
    """entities(session_id, ord, display_name, entity_type, assertion, confidence, attributes) -> (session_id, summary)."""
    get = lambda k: F.nullif(F.try_element_at("attributes", F.lit(k)), F.lit(""))
    value = F.coalesce(F.concat(F.lit("; value "), get("value"), F.coalesce(F.concat(F.lit(" "), get("unit")), F.lit(""))), F.lit(""))
    line = F.concat("display_name", F.lit(" ("), "entity_type", F.lit("; "), F.coalesce("assertion", F.lit("present")), F.lit("; "), "confidence", F.lit(" confidence"), value, F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return entities.groupBy("session_id").agg(F.array_join(lines, "\n").alias("summary"))


def in_display_order(entities: DataFrame) -> DataFrame:
    """entities gain shown: their place among their session's, by type in DISPLAY_ORDER, other types last, then by ord."""
    from pyspark.sql.window import Window

    place = F.array_position(F.array(*[F.lit(t) for t in DISPLAY_ORDER]), F.col("entity_type"))
    rank = F.when(place == 0, len(DISPLAY_ORDER) + 1).otherwise(place)
    return entities.withColumn("shown", F.row_number().over(Window.partitionBy("session_id").orderBy(rank, "entity_type", "ord")))
