"""Exchange resources of entities in full, and the quality of bundles read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.terminology import SYSTEM_URIS
from chartloom.operators.documents import resource_type
from chartloom.operators.sessions import _is, _items, _kind, _text

# Unit names of the exchange format; any other unit stays as it is.
UCUM = {"mmHg": "mm[Hg]", "beats/min": "{beats}/min", "breaths/min": "{breaths}/min", "%": "%", "Cel": "Cel", "degF": "[degF]", "kg": "kg", "lb": "[lb_av]"}
UCUM_SYSTEM = "http://unitsofmeasure.org"
CODED = ("Condition", "Observation", "MedicationStatement", "AllergyIntolerance", "ServiceRequest", "Procedure")


def ucum(unit: Column) -> Column:
    """The unit's code; an unknown unit is its own code, and no unit has none."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in UCUM.items() for x in kv]), unit)
    return F.when(unit != "", F.coalesce(named, unit))


def quantity(value: Column, unit: Column) -> Column:
    """The number that a value begins with, its unit and the unit's code."""
    number = F.nullif(F.regexp_extract(value, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")
    code = ucum(unit)
    return F.struct(number.alias("value"), unit.alias("unit"), F.when(code.isNotNull(), UCUM_SYSTEM).alias("system"), code.alias("code"))


def review_ready(codings: Column) -> Column:
    """The selected codings where there are any, else those that are not rejected."""
    chosen = F.filter(codings, lambda c: c["status"] == "selected")
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.filter(codings, lambda c: F.coalesce(c["status"] != "rejected", F.lit(True))))


def _concept(codings: Column, text: Column) -> Column:
    uri = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SYSTEM_URIS.items() for x in kv]), c["system"]), c["system"])
    return F.struct(F.transform(review_ready(codings), lambda c: F.struct(uri(c).alias("system"), c["code"].alias("code"), c["display"].alias("display"))).alias("coding"), text.alias("text"))


def _status(system: str, absent: Column, yes: str, no: str) -> Column:
    code, display = F.when(absent, no).otherwise(yes), F.when(absent, no.capitalize()).otherwise(yes.capitalize())
    return F.struct(F.array(F.struct(F.lit(f"http://terminology.hl7.org/CodeSystem/{system}").alias("system"), code.alias("code"), display.alias("display"))).alias("coding"))


def resources(entities: DataFrame) -> DataFrame:
    """entities(note_id, ord, id, entity_type, canonical_name, display_name, assertion, attributes, codings, mentions) -> their resources:

    (note_id, ord, resource_type, body).  codings: array<struct<system (a name), code, display, status>>; mentions:
    array<struct<start_char, end_char, text>>.  What a resource lacks is left out of its JSON.
    """
    kind = resource_type(F.col("entity_type"), F.col("assertion"))
    get = lambda k: F.nullif(F.try_element_at("attributes", F.lit(k)), F.lit(""))
    only = lambda which, c: F.when(kind == which, c)
    assertion = F.coalesce("assertion", F.lit("present"))
    absent = assertion == "absent"
    codings = F.coalesce("codings", F.array().cast("array<struct<system:string,code:string,display:string,status:string>>"))
    concept, subject = _concept(codings, F.col("display_name")), F.struct(F.lit("Prototype patient").alias("display"))
    notes = F.transform("mentions", lambda m: F.struct(F.concat(F.lit("Source span "), m["start_char"].cast("string"), F.lit("-"), m["end_char"].cast("string"), F.lit(": "), m["text"]).alias("text")))
    one_code = lambda system, code, display: F.struct(F.array(F.struct(F.lit(system).alias("system"), F.lit(code).alias("code"), F.lit(display).alias("display"))).alias("coding"), F.lit(display).alias("text"))
    pressure = (F.col("canonical_name") == "blood pressure") & get("systolic").isNotNull() & get("diastolic").isNotNull()
    part = lambda code, display, key: F.struct(one_code("http://loinc.org", code, display).alias("code"), quantity(get(key), F.lit("mmHg")).alias("valueQuantity"))
    numeric = get("value").rlike(r"^\s*[-+]?[0-9]*\.?[0-9]+")
    status = F.when(kind == "Observation", "final").when(kind == "MedicationStatement", F.when(absent, "not-taken").otherwise("active")).when(kind == "ServiceRequest", "active").when(kind == "Procedure", "completed")
    body = F.struct(
        kind.alias("resourceType"), F.col("id"), status.alias("status"),
        F.when(kind == "Condition", _status("condition-clinical", absent, "active", "inactive")).when(kind == "AllergyIntolerance", _status("allergyintolerance-clinical", absent, "active", "inactive")).alias("clinicalStatus"),
        F.when(kind == "Condition", _status("condition-ver-status", absent, "unconfirmed", "refuted")).when(kind == "AllergyIntolerance", _status("allergyintolerance-verification", absent, "unconfirmed", "refuted")).alias("verificationStatus"),
        only("ServiceRequest", F.when(assertion == "ordered", "order").otherwise("plan")).alias("intent"), only("AllergyIntolerance", F.when(get("severity") == "high", "high")).alias("criticality"),
        F.when(kind != "MedicationStatement", concept).alias("code"), only("MedicationStatement", concept).alias("medicationCodeableConcept"),
        only("Observation", F.when(F.col("entity_type") == "vital", F.array(one_code("http://terminology.hl7.org/CodeSystem/observation-category", "vital-signs", "Vital Signs")))).alias("category"),
        F.when(kind != "AllergyIntolerance", subject).alias("subject"), only("AllergyIntolerance", subject).alias("patient"),
        only("Observation", F.when(pressure, F.array(part("8480-6", "Systolic blood pressure", "systolic"), part("8462-4", "Diastolic blood pressure", "diastolic")))).alias("component"),
        only("Observation", F.when(~pressure & numeric, quantity(get("value"), F.coalesce(get("unit"), get("scale"))))).alias("valueQuantity"), only("Observation", F.when(~pressure & ~numeric, get("value"))).alias("valueString"),
        only("MedicationStatement", F.when(F.coalesce(get("sig"), get("dose")).isNotNull(), F.array(F.struct(F.coalesce(get("sig"), get("dose")).alias("text"))))).alias("dosage"),
        only("AllergyIntolerance", F.when(get("reaction").isNotNull(), F.array(F.struct(F.array(F.struct(get("reaction").alias("text"))).alias("manifestation"))))).alias("reaction"),
        notes.alias("note"),
    )
    return entities.select("note_id", "ord", kind.alias("resource_type"), F.to_json(body).alias("body"))


def bundles(found: DataFrame) -> DataFrame:
    """(note_id, body): the resources of a note as one collection, each under a URN made of its note and place."""
    entry = F.concat(F.lit('{"fullUrl":"urn:uuid:'), F.concat_ws("-", F.col("note_id").cast("string"), F.col("ord").cast("string")), F.lit('","resource":'), "body", F.lit("}"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("entry")))), lambda x: x["entry"])
    return found.groupBy("note_id").agg(F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join(listed, ","), F.lit("]}")).alias("body"))


def _object(v: Column, path: str) -> Column:
    return _is(v, path, "OBJECT")


def _has(v: Column, key: str) -> Column:
    return _kind(v, f"$.{key}").isNotNull()


def _entry_says(entry: Column, i: Column) -> Column:
    """struct<errors, warnings> of one entry of a bundle, in order."""
    n = (i + 1).cast("string")
    kind = F.coalesce(_text(entry, "$.resource.resourceType"), F.lit(""))
    at = F.concat(F.lit("FHIR "), kind, F.lit(" entry "), n)
    say = lambda when, *parts: F.when(when, F.concat(*parts))
    lit = F.lit
    whole, resource, known = _object(entry, "$"), _object(entry, "$.resource"), kind != ""
    r = lambda c: whole & resource & known & c
    code = lambda f: F.when(kind == "MedicationStatement", f("$.resource.medicationCodeableConcept")).otherwise(f("$.resource.code"))
    named = code(lambda p: _object(entry, p) & ((F.coalesce(F.trim(_text(entry, f"{p}.text")), lit("")) != "") | F.coalesce(F.size(_items(entry, f"{p}.coding")) > 0, lit(False))))
    codings = F.coalesce(code(lambda p: F.when(_object(entry, p), _items(entry, f"{p}.coding"))), F.array().cast("array<variant>"))
    coding_says = F.flatten(F.transform(codings, lambda c, k: F.array_compact(F.when(~_object(c, "$"), F.array(F.concat(at, lit(" coding "), (k + 1).cast("string"), lit(" is not an object.")))).otherwise(F.array(
        say(~F.coalesce(_text(c, "$.system").startswith("http"), lit(False)), at, lit(" coding "), (k + 1).cast("string"), lit(" has no absolute terminology system URI.")),
        say(F.coalesce(_text(c, "$.code"), lit("")) == "", at, lit(" coding "), (k + 1).cast("string"), lit(" is missing code.")),
    )))))
    observed = _has(entry, "resource.valueQuantity") | _has(entry, "resource.valueString") | _has(entry, "resource.component")
    errors = F.array_compact(F.array(
        say(~whole, lit("FHIR entry "), n, lit(" must be an object.")), say(whole & ~resource, lit("FHIR entry "), n, lit(" is missing a resource object.")), say(whole & resource & ~known, lit("FHIR entry "), n, lit(" resource is missing resourceType.")),
        say(r(F.coalesce(_text(entry, "$.resource.id"), lit("")) == ""), at, lit(" is missing id.")), say(r((kind == "Observation") & ~_is(entry, "$.resource.status", "STRING")), at, lit(" is missing status.")),
        say(r((kind == "ServiceRequest") & ~_is(entry, "$.resource.intent", "STRING")), at, lit(" is missing intent.")),
    ))
    coded = r(kind.isin(*CODED))
    warnings = F.concat(
        F.array_compact(F.array(
            say(whole & ~F.coalesce(_text(entry, "$.fullUrl").startswith("urn:uuid:"), lit(False)), lit("FHIR entry "), n, lit(" should use a urn:uuid fullUrl.")),
            say(r(~_object(entry, "$.resource.subject") & ~_object(entry, "$.resource.patient")), at, lit(" has no prototype subject/patient.")), say(coded & ~named, at, lit(" has no code text or coding.")),
        )),
        F.when(coded, coding_says).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(say(r((kind == "Observation") & ~observed), at, lit(" has no value or component.")))),
    )
    return F.struct(errors.alias("errors"), warnings.alias("warnings"), F.when(r(lit(True)), kind).alias("kind"))


def bundle_quality(found: DataFrame) -> DataFrame:
    """(note_id, body) -> (note_id, ok, errors, warnings, resource_count, resource_types map<string, int>).

    A body that is no JSON object has one error, one without an entry array no count.
    """
    rows = found.select("note_id", F.try_parse_json("body").alias("v"))
    v, none = F.col("v"), F.array().cast("array<string>")
    entries = F.transform(F.coalesce(_items(v, "$.entry"), F.array().cast("array<variant>")), _entry_says)
    rows = rows.withColumn("says", entries)
    object_, listed = _object(v, "$"), _is(v, "$.entry", "ARRAY")
    head = F.array_compact(F.array(F.when(~F.coalesce(_text(v, "$.resourceType") == "Bundle", F.lit(False)), "FHIR payload resourceType must be Bundle."), F.when(~listed, "FHIR Bundle must include an entry array.")))
    errors = F.when(~object_, F.array(F.lit("FHIR payload must be an object."))).otherwise(F.concat(head, F.flatten(F.transform("says", lambda s: s["errors"]))))
    plain = F.array_compact(F.array(F.when(object_ & ~F.coalesce(_text(v, "$.type") == "collection", F.lit(False)), "Prototype FHIR Bundle should use type=collection.")))
    warnings = F.when(object_, F.concat(plain, F.flatten(F.transform("says", lambda s: s["warnings"])))).otherwise(none)
    kinds = F.filter(F.transform("says", lambda s: s["kind"]), lambda k: k.isNotNull())
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    return rows.select("note_id", (F.size(errors) == 0).alias("ok"), errors.alias("errors"), warnings.alias("warnings"), F.size(kinds).alias("resource_count"), counts.alias("resource_types"))


def bundle_check(found: DataFrame) -> DataFrame:
    """(note_id, body) -> (note_id, ok, errors, warnings) as a preview is checked: the bundle's own faults first, then its quality."""
    q = bundle_quality(found)
    v = F.try_parse_json("body")
    flags = found.select(F.col("note_id"), _object(v, "$").alias("_object"), F.coalesce(_text(v, "$.resourceType") == "Bundle", F.lit(False)).alias("_bundle"), _is(v, "$.entry", "ARRAY").alias("_listed"))
    rows = q.join(flags, "note_id")
    no_object, no_bundle, none = ~F.col("_object"), ~F.col("_bundle"), F.array().cast("array<string>")
    errors = F.when(no_object, F.array(F.lit("FHIR preview must be a JSON object."))).when(no_bundle, F.array(F.lit("FHIR preview resourceType must be Bundle."))).otherwise(F.col("errors"))
    bare = F.when(~F.col("_listed"), F.array(F.lit("FHIR Bundle preview has no entry array."))).otherwise(none)
    warnings = F.when(no_object | no_bundle, none).otherwise(F.concat(bare, "warnings"))
    return rows.select("note_id", (F.size(errors) == 0).alias("ok"), errors.alias("errors"), warnings.alias("warnings"))


def reviewer_report(sessions: DataFrame, entities: DataFrame) -> DataFrame:
    """A reviewer's report a session: counts, entities with review state, codes and sources, then the note.

    sessions(session_id, specialty_label, text); entities(session_id, ord, display_name, entity_type, assertion, confidence,
    review_status, review_note, priority, codings with status, texts).
    """
    assertion = F.coalesce("assertion", F.lit("present"))
    chosen = F.filter(F.coalesce("codings", F.array().cast("array<struct<system:string,code:string,display:string,status:string>>")), lambda c: c["status"] == "selected")
    codes = F.array_join(F.transform(chosen, lambda c: F.concat_ws(" ", c["system"], c["code"])), ", ")
    source = F.array_join(F.transform("texts", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), "; ")
    lines = F.array_compact(F.array(
        F.concat(F.lit("### "), "display_name"), F.concat(F.lit("Type: "), "entity_type"), F.concat(F.lit("Assertion: "), assertion), F.concat(F.lit("Confidence: "), "confidence"), F.concat(F.lit("Review: "), F.coalesce("review_status", F.lit("unreviewed"))),
        F.concat(F.lit("Selected codes: "), F.when(codes == "", "none").otherwise(codes)), F.concat(F.lit("Source: "), F.when(source == "", "none").otherwise(source)), F.concat(F.lit("Reviewer note: "), F.nullif("review_note", F.lit(""))),
    ))
    rows = entities.select("session_id", "ord", F.array_join(lines, "\n").alias("lines"), (F.col("review_status") == "reviewed").cast("int").alias("seen"), F.size(chosen).alias("n_codes"), (F.col("priority") == "high").cast("int").alias("high"))
    told = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("seen").alias("seen"), F.sum("n_codes").alias("codes"), F.sum("high").alias("high"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "lines"))), lambda x: x["lines"]).alias("parts"))
    out = sessions.join(told, "session_id", "left")
    count = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(0).cast("bigint")).cast("string"))
    text = F.when(F.trim("text") == "", "(blank)").otherwise(F.trim("text"))
    head = F.array(F.lit("# Clinical Entity Extraction Review"), F.lit(""), F.concat(F.lit("Specialty: "), "specialty_label"), count("Entity count", "n"), count("Reviewed", "seen"), count("Selected codes", "codes"), count("High priority review", "high"), F.lit(""), F.lit("## Entities"))
    body = F.concat(head, F.coalesce("parts", F.array().cast("array<string>")), F.array(F.lit(""), F.lit("## Source Text"), F.coalesce(text, F.lit("(blank)"))))
    return out.select("session_id", F.array_join(body, "\n").alias("report"))
