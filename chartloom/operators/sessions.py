"""Sessions: import with validation, the library of saved sessions, and the edits of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.terminology import CONFIDENCE, SYSTEMS
from chartloom.operators.documents import latest

# What a session may hold.
SPECIALTIES = ("primary-care", "mental-health", "physical-therapy", "mixed")
ENTITY_TYPES = (
    "problem", "symptom", "finding", "medication", "allergy", "procedure", "lab", "vital", "score", "body-site", "laterality", "duration", "severity", "functional-limitation",
    "plan", "referral", "imaging", "exercise", "special-test", "risk", "other",
)
ASSERTIONS = ("present", "absent", "possible", "conditional", "hypothetical", "historical", "family-history", "planned", "ordered", "conflicting", "unknown")
SCHEMA_VERSION = "prototype-1"


def session_name(text: Column) -> Column:
    """The first line of a note that is not blank, cut to 61 signs and dots where it has over 64."""
    line = F.try_element_at(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    short = F.when(F.length(line) > 64, F.concat(F.substring(line, 1, 61), F.lit("..."))).otherwise(line)
    return F.coalesce(short, F.lit("Untitled clinical note"))


def _kind(v: Column, path: str) -> Column:
    """The type of a part of a variant as written: STRING, ARRAY<...>, ...; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(_kind(v, path).startswith(kind), F.lit(False))


def _number(v: Column, path: str) -> Column:
    return F.coalesce(_kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))


def _text(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "STRING"), F.try_variant_get(v, path, "string"))


def _in(v: Column, path: str, values) -> Column:
    return F.coalesce(_text(v, path).isin(*values), F.lit(False))


def _items(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _problems(e: Column, i: Column) -> Column:
    """Errors of one entity, in order."""
    name = F.concat(F.lit("Entity "), (i + 1).cast("string"))
    say = lambda when, what: F.when(when, F.concat(name, F.lit(what)))
    own = F.array_compact(
        F.array(
            *[say(~_is(e, f"$.{k}", "STRING"), f" is missing {k}.") for k in ("id", "canonicalName", "displayName")],
            say(~_in(e, "$.type", ENTITY_TYPES), " has invalid type."), say(~_in(e, "$.confidence", CONFIDENCE), " has invalid confidence."), say(~_is(e, "$.mentions", "ARRAY"), " is missing mentions."),
        )
    )
    good = lambda m: _is(m, "$.text", "STRING") & _number(m, "$.start") & _number(m, "$.end")
    mentions = F.coalesce(F.array_compact(F.transform(_items(e, "$.mentions"), lambda m, k: F.when(~good(m), F.concat(name, F.lit(" mention "), (k + 1).cast("string"), F.lit(" is invalid."))))), F.array().cast("array<string>"))
    return F.when(~_is(e, "$", "OBJECT"), F.array(F.concat(name, F.lit(" must be an object.")))).otherwise(F.concat(own, mentions))


def _coding_ok(c: Column) -> Column:
    return _in(c, "$.system", SYSTEMS) & _is(c, "$.code", "STRING") & _is(c, "$.display", "STRING") & _in(c, "$.confidence", CONFIDENCE)


def _warnings(e: Column, i: Column) -> Column:
    name = F.concat(F.lit("Entity "), (i + 1).cast("string"))
    dropped = F.array_compact(F.transform(_items(e, "$.codings"), lambda c, k: F.when(~_coding_ok(c), F.concat(name, F.lit(" coding "), (k + 1).cast("string"), F.lit(" was dropped during import.")))))
    none = F.array().cast("array<string>")
    valid = F.filter(F.coalesce(_items(e, "$.specialties"), F.array().cast("array<variant>")), lambda s: _in(s, "$", SPECIALTIES))
    bare = F.when((F.size(_problems(e, i)) == 0) & (F.size(valid) == 0), F.array(F.concat(name, F.lit(" had no valid specialties.")))).otherwise(none)
    return F.when(_is(e, "$", "OBJECT"), F.concat(F.coalesce(dropped, none), bare)).otherwise(none)


def validated(raw: DataFrame) -> DataFrame:
    """raw(session_id, raw) -> (session_id, ok, errors, warnings, specialty, source_text, entities array<variant>).

    What is no JSON, or no object, has one error.  Entities with an error make the session fail; codings that are not whole
    are dropped with a warning.  A session that fails has no specialty, text and entities here.
    """
    rows = raw.select("session_id", F.try_parse_json("raw").alias("v"))
    v, none = F.col("v"), F.array().cast("array<string>")
    entities = F.coalesce(_items(v, "$.entities"), F.array().cast("array<variant>"))
    of_all = lambda f: F.flatten(F.transform(entities, f))
    head = F.array_compact(
        F.array(
            F.when(~F.coalesce(_text(v, "$.schemaVersion") == SCHEMA_VERSION, F.lit(False)), "Unsupported or missing schemaVersion."), F.when(~_in(v, "$.specialty", SPECIALTIES), "Missing or invalid specialty."),
            F.when(~_is(v, "$.sourceText", "STRING"), "Missing sourceText."), F.when(~_is(v, "$.entities", "ARRAY"), "Missing entities array."),
        )
    )
    errors = F.when(v.isNull(), F.array(F.lit("Import file is not valid JSON."))).when(~_is(v, "$", "OBJECT"), F.array(F.lit("Imported file must contain a JSON object."))).otherwise(F.concat(head, of_all(_problems)))
    rebuilt = F.array_compact(F.array(*[F.when(_kind(v, f"$.{k}").isNull() | (_kind(v, f"$.{k}") == "VOID"), said) for k, said in (("summary", "Summary was rebuilt during import."), ("terminology", "Terminology manifest was rebuilt during import."))]))
    rows = rows.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)
    warnings = F.when(v.isNull() | ~_is(v, "$", "OBJECT"), none).otherwise(F.concat(of_all(_warnings), F.when(F.col("ok"), rebuilt).otherwise(none)))
    keep = lambda c: F.when(F.col("ok"), c)
    return rows.select("session_id", "ok", "errors", warnings.alias("warnings"), keep(_text(v, "$.specialty")).alias("specialty"), keep(_text(v, "$.sourceText")).alias("source_text"), keep(entities).alias("entities"))


def library(log: DataFrame) -> DataFrame:
    """log(session_id, op, saved_at, ...) of saves and deletes -> the sessions that are there: the last save, if no delete follows it.

    Of a save and a delete at one time, the delete counts.
    """
    return latest(log, ["session_id"], [F.desc("saved_at"), F.when(F.col("op") == "delete", 0).otherwise(1).asc()]).where("op = 'save'").drop("op")


def reviewed(codings: DataFrame, events: DataFrame) -> DataFrame:
    """Codings with the status that the events left them: codings(entity_id, system, code, status), events(entity_id, system, code, status, at).

    A coding has the status of its newest event.  Selecting a code sets the other selected codes of its system back to
    candidate: a selection counts only where no other code of the system was selected later.
    """
    keys = ["entity_id", "system", "code"]
    own = latest(events, keys, [F.desc("at")]).select(*keys, F.col("status").alias("new_status"), "at")
    chosen = events.where("status = 'selected'").groupBy("entity_id", "system").agg(F.max(F.struct("at", "code")).alias("last"))
    rows = codings.join(own, keys, "left").join(chosen, ["entity_id", "system"], "left")
    status = F.coalesce("new_status", "status")
    replaced = (status == "selected") & F.col("last").isNotNull() & (F.col("last.code") != F.col("code")) & (F.col("at").isNull() | (F.col("last.at") >= F.col("at")))
    return rows.select(*keys, F.when(replaced, "candidate").otherwise(status).alias("status"))


def with_status(rows: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, status, ...) with the status of their newest event; events(keys, status, at)."""
    own = latest(events, keys, [F.desc("at")]).select(*keys, F.col("status").alias("_new"))
    return rows.join(own, keys, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def edited(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """entities(entity_id, display_name, assertion, review_status, ...) after edits(entity_id, op, display_name, assertion, at).

    op is edit (its fields that are not null replace the entity's, the newest of each field), review (marks it reviewed) or
    delete (the entity is gone, whatever else there is).
    """
    newest = lambda c: F.max_by(F.when(F.col("op") == "edit", F.col(c)), F.when((F.col("op") == "edit") & F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}")
    made = edits.groupBy("entity_id").agg(newest("display_name"), newest("assertion"), F.bool_or(F.col("op") == "delete").alias("_gone"), F.bool_or(F.col("op").isin("edit", "review")).alias("_seen"))
    rows = entities.join(made, "entity_id", "left").where("NOT coalesce(_gone, FALSE)")
    rows = rows.withColumns({"display_name": F.coalesce("_display_name", "display_name"), "assertion": F.coalesce("_assertion", "assertion"), "review_status": F.when(F.coalesce("_seen", F.lit(False)), "reviewed").otherwise(F.col("review_status"))})
    return rows.drop("_display_name", "_assertion", "_gone", "_seen")


def selection_sentence(text: Column, start: Column, end: Column) -> Column:
    """What stands around a selection: from behind the last . or line end before it to the next one behind it, trimmed."""
    before, after = F.substr(text, F.lit(1), start), F.substr(text, end + 1)
    head = F.regexp_extract(before, r"[^.\n]*\z", 0)
    tail = F.regexp_extract(after, r"\A[^.\n]*\.?", 0)
    return F.trim(F.concat(head, F.substr(text, start + 1, end - start), tail))


def manual_entities(selections: DataFrame) -> DataFrame:
    """selections(session_id, text, start, end, entity_type) of a note's text -> entities as a reviewer adds them; blanks are left out."""
    chosen = F.trim(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    rows = selections.withColumn("chosen", chosen).where("chosen <> ''")
    return rows.select(
        "session_id", F.concat_ws("-", F.lit("manual"), "entity_type", F.col("start").cast("string"), F.col("end").cast("string")).alias("entity_id"), F.lower("chosen").alias("canonical_name"), F.col("chosen").alias("display_name"),
        "entity_type", F.lit("present").alias("assertion"), F.lit("high").alias("confidence"), F.lit("reviewed").alias("review_status"), selection_sentence(F.col("text"), F.col("start"), F.col("end")).alias("sentence"),
    )
