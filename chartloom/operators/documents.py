"""Whole documents from mentions and entities: envelope, client entities, resources, reports, sessions and their import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.operators import rollup as R
from chartloom.operators.validation import confidence_label

MAX_NOTE_CHARS = 100_000
# Error codes of the request check, in the order in which they are tried.
REQUEST_OPS = ("extract", "ping")
OBSERVATIONS = ("lab", "vital", "score", "finding", "severity", "special-test")
REQUESTS = ("plan", "referral", "imaging")


def request_error(op: Column, text: Column) -> Column:
    """The error code of a request, or null: unknown-op, invalid-text, note-too-large."""
    extract = op == "extract"
    return F.when(~F.coalesce(op.isin(*REQUEST_OPS), F.lit(False)), "unknown-op").when(extract & text.isNull(), "invalid-text").when(extract & (F.length(text) > MAX_NOTE_CHARS), "note-too-large")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "(^-|-$)", "")


def title_case(c: Column) -> Column:
    """First letters of words raised; the rest as it is."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


def envelope(mentions: DataFrame, spark: SparkSession) -> DataFrame:
    """(note_id, body): the engine's answer for a note as JSON, mentions in offset order, entities by first mention."""
    m = F.struct("text", "entity_type", "start_char", "end_char", "assertion", "confidence_score", "normalized_text", "section_context", "attributes")
    in_order = F.array_sort(F.collect_list(F.struct("mention_idx", F.to_json(m, {"ignoreNullFields": "false"}).alias("m"))))
    listed = mentions.groupBy("note_id").agg(F.transform(in_order, lambda x: x["m"]).alias("mentions"))
    index = F.array_sort(F.collect_list("mention_idx")).alias("mention_indexes")
    entities = R.code(R.rollup(mentions, index).drop("mentions"), F.col("canonical_text"), spark)
    e = F.struct("first_start", "entity_type", "canonical_text", "assertion", "review_priority", "mention_indexes", "codings", "is_coded")
    grouped = entities.groupBy("note_id").agg(F.array_sort(F.collect_list(e)).alias("entities"))
    out = listed.join(grouped, "note_id")
    listing = F.to_json(F.transform("entities", lambda x: x.dropFields("first_start")), {"ignoreNullFields": "false"})
    return out.select("note_id", F.concat(F.lit('{"mentions":['), F.array_join("mentions", ","), F.lit('],"entities":'), listing, F.lit("}")).alias("body"))


def client_entities(mentions: DataFrame, spark: SparkSession) -> DataFrame:
    """One row an entity as the client shows it: id, names, top confidence as a word, reasons for review, priority."""
    e = R.code(R.rollup(mentions, F.max("confidence_score").alias("top")).drop("mentions"), F.col("canonical_text"), spark)
    w = Window.partitionBy("note_id").orderBy("first_start", "entity_type", "canonical_text")
    e = e.withColumn("ord", F.row_number().over(w) - 1)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("assertion") == "conflicting", "Mentions disagree on assertion; requires human resolution."),
            F.when(F.col("assertion") == "unknown", "Assertion could not be resolved; requires human review."),
            F.when(~F.col("is_coded"), "No release-pinned terminology candidate yet."),
        )
    )
    priority = F.when(F.col("review_priority") == "high", "high").when(F.size("reasons") > 0, "needs-review").otherwise("routine")
    e = e.withColumn("reasons", reasons).withColumn("priority", priority)
    return e.select(
        "note_id", F.concat_ws("-", "entity_type", slug(F.col("canonical_text")), F.col("ord").cast("string")).alias("id"), "canonical_text", title_case(F.col("canonical_text")).alias("display_name"),
        "entity_type", "assertion", "priority", F.array_join("reasons", " | ").alias("reasons"), confidence_label(F.col("top")).alias("confidence"),
    )


def resource_type(kind: Column, assertion: Column) -> Column:
    """The exchange resource an entity becomes."""
    return (
        F.when(kind == "allergy", "AllergyIntolerance").when(kind == "medication", "MedicationStatement").when(kind.isin(*REQUESTS) | F.coalesce(assertion == "ordered", F.lit(False)), "ServiceRequest")
        .when(kind.isin(*OBSERVATIONS), "Observation").when(kind.isin("procedure", "exercise"), "Procedure").otherwise("Condition")
    )


def resources(mentions: DataFrame) -> DataFrame:
    """(note_id, ord, resource_type, body): one resource a mention, as JSON; blood pressure has two components."""
    absent = F.col("assertion") == "absent"
    kind = resource_type(F.col("entity_type"), F.col("assertion"))
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    quantity = lambda v, u: F.struct(F.expr(f"try_cast(attributes['{v}'] AS DOUBLE)").alias("value"), u.alias("unit"))
    part = lambda code, text, v: F.struct(F.lit(code).alias("code"), F.lit(text).alias("text"), quantity(v, F.lit("mmHg")).alias("valueQuantity"))
    bp = (F.col("normalized_text") == "blood pressure") & get("systolic").isNotNull() & get("diastolic").isNotNull()
    body = F.struct(
        kind.alias("resourceType"),
        F.struct(F.col("normalized_text").alias("text")).alias("code"),
        F.when(kind == "Condition", F.when(absent, "inactive").otherwise("active")).alias("clinicalStatus"),
        F.when(kind == "Condition", F.when(absent, "refuted").otherwise("unconfirmed")).alias("verificationStatus"),
        F.when((kind == "Observation") & ~bp & get("value").isNotNull(), quantity("value", F.coalesce(get("unit"), get("scale")))).alias("valueQuantity"),
        F.when((kind == "Observation") & bp, F.array(part("8480-6", "Systolic blood pressure", "systolic"), part("8462-4", "Diastolic blood pressure", "diastolic"))).alias("component"),
    )
    return mentions.select("note_id", F.col("mention_idx").alias("ord"), kind.alias("resource_type"), F.to_json(body).alias("body"))


def bundles(found: DataFrame) -> DataFrame:
    """(note_id, n, body): the resources of a note as one collection."""
    return found.groupBy("note_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]).alias("entries")).select(
        "note_id", "n", F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join(F.transform("entries", lambda b: F.concat(F.lit('{"resource":'), b, F.lit("}"))), ","), F.lit("]}")).alias("body")
    )


def bundle_problems(found: DataFrame) -> DataFrame:
    """(note_id, errors, n_entries, types) of bundles read back from JSON; a body that is no JSON is one error."""
    entry = "struct<resourceType:string, type:string, entry:array<struct<resource:struct<resourceType:string, code:struct<text:string>>>>>"
    rows = found.withColumn("b", F.from_json("body", entry, {"mode": "PERMISSIVE"}))
    errors = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("b.resourceType") != "Bundle", F.lit(True)), "resourceType must be Bundle."),
            F.when(F.coalesce(F.col("b.type") != "collection", F.lit(True)), "type must be collection."),
            F.when(F.coalesce(F.exists("b.entry", lambda e: e["resource"]["resourceType"].isNull()), F.lit(True)), "every entry needs a resourceType."),
        )
    )
    types = F.array_join(F.array_sort(F.array_distinct(F.transform("b.entry", lambda e: e["resource"]["resourceType"]))), ",")
    return rows.select("note_id", F.array_join(errors, " ").alias("errors"), F.coalesce(F.size("b.entry"), F.lit(0)).alias("n_entries"), types.alias("types"))


def reports(entities: DataFrame) -> DataFrame:
    """(note_id, report): a reviewer's list of a note's entities, a line each, in order of place."""
    line = F.concat(F.lit("- "), title_case(F.col("canonical_text")), F.lit(" ("), F.col("entity_type"), F.lit(", "), F.col("assertion"), F.lit(", "), F.col("review_priority"), F.lit(")"))
    rows = entities.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_start", "entity_type", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return rows.select("note_id", F.concat_ws("\n", F.lit("# Entities"), F.array_join("lines", "\n")).alias("report"))


def uncertainty(entities: DataFrame) -> DataFrame:
    """entities(assertion, confidence, entity_type, n_codings, low_coding, n_relations, texts, sections) gain reasons, priority."""
    ambiguous, helpful = ("PT", "ER", "IR", "CP", "SI", "HI", "DM", "US"), ("medication", "imaging", "referral", "plan", "exercise", "score")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("assertion") == "conflicting", "conflicting-assertion"), F.when(F.col("confidence") == "low", "low-confidence"),
            F.when(F.exists("texts", lambda t: F.upper(F.trim(t)).isin(*ambiguous)), "ambiguous-shorthand"),
            F.when((F.col("n_codings") == 0) & ~F.col("entity_type").isin("duration", "laterality", "body-site", "other"), "no-terminology-candidate"),
            F.when(F.col("low_coding"), "broad-code"), F.when(F.col("entity_type").isin(*helpful) & (F.col("n_relations") == 0), "no-linked-target"),
            F.when(F.exists("sections", lambda s: s.isNull() | (s == "unknown")), "outside-known-section"),
        )
    )
    out = entities.withColumn("uncertainty_reasons", reasons)
    n = F.size("uncertainty_reasons")
    return out.withColumn("priority", F.when(F.col("assertion") == "conflicting", "high").when(n == 0, "routine").when((F.col("confidence") == "low") | (n >= 2), "high").otherwise("needs-review"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
