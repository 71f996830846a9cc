"""Entities from mentions, their codes, review priorities and export gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import lexicon as L
from chartloom.operators.lineage import fixed


def canonical() -> Column:
    """The name mentions are grouped by: normalized text where there is one, else the text; trimmed, lower case."""
    return F.lower(F.trim(F.coalesce(F.nullif("normalized_text", F.lit("")), F.col("text"))))


def rollup(mentions: DataFrame, *more: Column) -> DataFrame:
    """mentions -> one row a (note, type, canonical name): assertion, priority, mention count, spans in order.

    Mentions that agree give their assertion; present with historical on a chronic condition gives present; any other
    disagreement is conflicting.  Conflicting and unknown entities have high review priority.  more: further aggregates of the
    same rows, as columns, so that what makes the mentions runs once.
    """
    rows = mentions.withColumn("canonical_text", canonical())
    spans = F.array_sort(F.collect_list(F.struct("start_char", "end_char", "assertion")))
    out = rows.groupBy("note_id", "entity_type", "canonical_text").agg(F.array_sort(F.collect_set("assertion")).alias("kinds"), spans.alias("mentions"), *more)
    own = out.columns[5:]
    mixed = (F.array_join("kinds", ",") == "historical,present") & F.col("canonical_text").isin(*L.CHRONIC)
    assertion = F.when(F.size("kinds") == 1, F.col("kinds")[0]).when(mixed, "present").otherwise("conflicting")
    out = out.withColumn("assertion", assertion)
    return out.select(
        "note_id", "entity_type", "canonical_text", "assertion",
        F.when(F.col("assertion").isin("conflicting", "unknown"), "high").otherwise("routine").alias("review_priority"),
        F.size("mentions").alias("mention_count"), F.col("mentions")[0]["start_char"].alias("first_start"), "mentions", *own,
    )


def starter_codes(spark: SparkSession) -> DataFrame:
    """The built-in codes: a table of a handful of rows."""
    return fixed(spark, L.STARTER_CODES, "name string, entity_type string, system string, code string, display string, confidence double")


def code(rows: DataFrame, name: Column, spark: SparkSession, codes: DataFrame | None = None, seed: DataFrame | None = None) -> DataFrame:
    """rows gain codings (array) and is_coded.  A code by name and type hides the seed's codes by name alone.

    seed: (canonical_name, system, code, display, release_version, confidence).  Only a release-pinned code makes a row coded.
    """
    kind = "array<struct<system:string,code:string,display:string,release_version:string,confidence:double>>"
    own = codes if codes is not None else starter_codes(spark)
    one = F.struct("system", "code", "display", F.lit(None).cast("string").alias("release_version"), "confidence")
    own = own.groupBy(F.col("name").alias("_n"), F.col("entity_type").alias("_t")).agg(F.collect_list(one).cast(kind).alias("_own"))
    rows = rows.withColumn("_name", name)
    out = rows.join(own, (F.col("_name") == F.col("_n")) & (F.col("entity_type") == F.col("_t")), "left")
    if seed is not None:
        each = seed.groupBy(F.lower("canonical_name").alias("_s")).agg(F.collect_list(F.struct("system", "code", "display", "release_version", "confidence")).cast(kind).alias("_seed"))
        out = out.join(each, F.lower(F.trim("_name")) == F.col("_s"), "left")
    else:
        out = out.withColumn("_seed", F.lit(None).cast(kind)).withColumn("_s", F.lit(None))
    out = out.withColumn("codings", F.coalesce("_own", "_seed", F.array().cast(kind)))
    return out.withColumn("is_coded", F.exists("codings", lambda c: c["release_version"].isNotNull())).drop("_n", "_t", "_own", "_s", "_seed", "_name")


ACK_REQUIRED = ("risk", "medication", "allergy")
PASS_TYPES = ("vital", "score")


def gate(entities: DataFrame, acknowledged: Column | None = None, escalation_failed: Column | None = None, interim_strict: bool = True) -> DataFrame:
    """entities gain tier (blocked, flagged, pass) and reason: what may leave the system, and what must be reviewed first.

    acknowledged: array of acknowledged types; escalation_failed: boolean.
    """
    acked = acknowledged if acknowledged is not None else F.array().cast("array<string>")
    failed = F.coalesce(escalation_failed, F.lit(False)) if escalation_failed is not None else F.lit(False)
    needs = F.col("entity_type").isin(*ACK_REQUIRED)
    seen = needs & F.coalesce(F.array_contains(acked, F.col("entity_type")), F.lit(False))
    plain = F.when(F.col("entity_type").isin(*PASS_TYPES), "pass").otherwise("flagged")
    strict = F.when(F.lit(interim_strict) & ~seen, F.when(plain == "pass", "flagged").otherwise("blocked")).otherwise(plain)
    capped = F.when(failed & (strict == "pass"), "flagged").otherwise(strict)
    conflict, unknown = F.col("assertion") == "conflicting", F.col("assertion") == "unknown"
    tier = F.when(conflict | unknown | (needs & ~seen), "blocked").otherwise(capped)
    reason = F.when(conflict, "conflicting-assertion").when(unknown, "unknown-assertion").when(needs & ~seen, "reviewer-ack-required").when(capped == "flagged", "unreviewed").otherwise("ok")
    return entities.withColumn("tier", tier).withColumn("reason", reason)


def gate_documents(gated: DataFrame) -> DataFrame:
    """(note_id, ok, n_blocked, n_entities): a document with one blocked entity is not exported at all."""
    out = gated.groupBy("note_id").agg(F.count_if(F.col("tier") == "blocked").alias("n_blocked"), F.count("*").alias("n_entities"))
    return out.withColumn("ok", F.col("n_blocked") == 0)
