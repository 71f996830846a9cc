"""A second derived view, in which every pattern family and a share of the dictionary occur, with what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.sources.notes import filled, literal, spread

TEMPLATES = [
    "PHQ-9: {phq}. GAD-7 8. AUDIT-C 3. C-SSRS 2. BMI 31.5.",
    "A1c 7.8. Hgb 13.2 g/dL. TSH 2.1. LDL 130. BP 140 / 90, pulse {hr} bpm.",
    "RR 16, SpO2 97%, temp 98.6 F, wt 180 lb.",
    "Pain {pain}/10. AROM flexion 120. ER 4-/5. TUG 14 sec. 5xSTS 16 seconds.",
    "Seen for {wk} weeks. Follow up in 6 months. PT cont 2x/wk. Denies tobacco. Alcohol: social.",
    "Smokes 1 ppd. Uses marijuana daily. FHx: mother with diabetes. Father had CAD.",
    "Ordered MRI of lumbar spine. Referral to psych. Colonoscopy done.",
    "Antalgic gait, poor balance, fall risk. Panic attacks, hypomania. Safety plan reviewed.",
    "Lisinopril {mg} mg PO daily. Ibuprofen 400 mg q6h PRN pain. Albuterol inhaler 2 puffs q4h PRN wheeze.",
    "NKDA. Allergic to pcn with rash.",
    "HTN and COPD. Denies chest pain. Reports right knee pain.\nPMH: asthma\nPlan: f/u.",
    "No fever or cough. Check CBC today. Bilateral hip pain, dizzy.",
]

#: (template, type, canonical name, text, value, unit, assertion, detail), by hand.
FAMILY_TRUTH = [
    (0, "score", "Patient Health Questionnaire-9", "PHQ-9: {phq}", "{phq}", None, None, None),
    (0, "score", "Generalized Anxiety Disorder-7", "GAD-7 8", "8", None, None, None),
    (0, "score", "Alcohol Use Disorders Identification Test-Consumption", "AUDIT-C 3", "3", None, None, None),
    (0, "score", "Columbia Suicide Severity Rating Scale", "C-SSRS 2", "2", None, None, None),
    (0, "vital", "body mass index", "BMI 31.5", "31.5", None, None, None),
    (1, "lab", "hemoglobin A1c", "A1c 7.8", "7.8", "%", None, None),
    (1, "lab", "hemoglobin", "Hgb 13.2 g/dL", "13.2", "g/dL", None, None),
    (1, "lab", "thyroid stimulating hormone", "TSH 2.1", "2.1", "uIU/mL", None, None),
    (1, "lab", "low density lipoprotein cholesterol", "LDL 130", "130", "mg/dL", None, None),
    (1, "vital", "blood pressure", "BP 140 / 90", "140/90", "mmHg", None, None),
    (1, "vital", "heart rate", "pulse {hr} bpm", "{hr}", "beats/min", None, None),
    (2, "vital", "respiratory rate", "RR 16", "16", "breaths/min", None, None),
    (2, "vital", "oxygen saturation", "SpO2 97", "97", "%", None, None),
    (2, "vital", "body temperature", "temp 98.6 F", "98.6", "degF", None, None),
    (2, "vital", "body weight", "wt 180 lb", "180", "lb", None, None),
    (3, "severity", "pain rating", "Pain {pain}/10", "{pain}/10", None, None, "{pain}"),
    (3, "finding", "range of motion measurement", "AROM flexion 120", "120", "degrees", None, "flexion"),
    (3, "finding", "range of motion measurement", "ER 4", "4", "degrees", None, "ER"),
    (3, "finding", "manual muscle test", "ER 4-/5", "4-/5", None, None, "ER"),
    (3, "functional-limitation", "Timed Up and Go", "TUG 14 sec", "14", "seconds", None, None),
    (3, "functional-limitation", "five times sit to stand", "5xSTS 16 seconds", "16", "seconds", None, None),
    (4, "duration", "duration", "for {wk} weeks", "{wk}", "weeks", None, "{wk} weeks"),
    (4, "plan", "follow up", "Follow up in 6 months", "6 months", None, None, "6 months"),
    (4, "plan", "treatment frequency", "cont 2x/wk", "2x/wk", None, None, "2x/wk"),
    (4, "risk", "tobacco use", "Denies tobacco", None, None, "absent", None),
    (4, "risk", "alcohol use", "Alcohol: social", "social", None, "present", None),
    (5, "risk", "tobacco use", "Smokes 1 ppd", "1 ppd", None, "present", None),
    (5, "risk", "substance use", "Uses marijuana daily", "marijuana", None, None, "daily"),
    (5, "risk", "family history of diabetes mellitus", "FHx: mother with diabetes", None, None, "family-history", "mother"),
    (5, "risk", "family history of diabetes mellitus", "mother with diabetes", None, None, "family-history", "mother"),
    (5, "risk", "family history of heart disease", "Father had CAD", None, None, "family-history", "father"),
    (5, "imaging", "es marijuana daily ultrasound", "Uses marijuana daily", None, None, "present", "es marijuana daily"),
    (6, "imaging", "lumbar spine MRI", "Ordered MRI of lumbar spine", None, None, "ordered", "lumbar spine"),
    (6, "referral", "referral to psychiatry", "Referral to psych", None, None, "planned", None),
    (6, "procedure", "colonoscopy", "Colonoscopy", None, None, None, None),
    (7, "finding", "gait abnormality", "Antalgic gait", "antalgic gait", None, None, None),
    (7, "functional-limitation", "impaired balance", "poor balance", "poor balance", None, None, None),
    (7, "risk", "fall risk", "fall risk", "fall risk", None, None, None),
    (7, "symptom", "panic attacks", "Panic attacks", None, None, None, None),
    (7, "finding", "mania", "hypomania", "hypomania", None, None, None),
    (7, "risk", "safety plan", "Safety plan", None, None, "planned", None),
    (8, "medication", "lisinopril", "Lisinopril {mg} mg PO daily", "{mg} mg", None, None, "{mg} mg PO daily"),
    (8, "medication", "ibuprofen", "Ibuprofen 400 mg q6h PRN pain", "400 mg", None, None, "400 mg q6h as needed for pain"),
    (8, "medication", "albuterol", "Albuterol inhaler 2 puffs q4h PRN wheeze", "2 puff", None, None, "2 puff inhaled q4h as needed for wheeze"),
    (9, "allergy", "no known drug allergies", "NKDA", None, None, "absent", None),
    (9, "allergy", "penicillin allergy", "Allergic to pcn with rash", None, None, "present", "rash"),
]

#: (template, type, canonical name, text, which occurrence, confidence, assertion, temporality, side) of the dictionary scan.
DICTIONARY_TRUTH = [
    (0, "score", "Patient Health Questionnaire-9", "PHQ-9", "high", "present", None, None),
    (0, "score", "Generalized Anxiety Disorder-7", "GAD-7", "high", "present", None, None),
    (0, "score", "Alcohol Use Disorders Identification Test-Consumption", "AUDIT-C", "high", "present", None, None),
    (0, "score", "Columbia Suicide Severity Rating Scale", "C-SSRS", "high", "present", None, None),
    (0, "vital", "body mass index", "BMI", "medium", "present", None, None),
    (1, "lab", "hemoglobin A1c", "A1c", "medium", "present", None, None),
    (3, "finding", "active range of motion", "AROM", "high", "present", None, None),
    (3, "finding", "flexion", "flexion", "high", "present", None, None),
    (3, "finding", "external rotation", "ER", "medium", "present", None, None),
    (3, "functional-limitation", "Timed Up and Go", "TUG", "medium", "present", None, None),
    (3, "functional-limitation", "five times sit to stand", "5xSTS", "high", "present", None, None),
    (4, "plan", "follow up", "Follow up", "high", "present", None, None),
    (5, "problem", "coronary artery disease", "CAD", "medium", "present", None, None),
    (8, "medication", "lisinopril", "Lisinopril", "high", "present", None, None),
    (8, "medication", "ibuprofen", "Ibuprofen", "high", "present", None, None),
    (8, "medication", "albuterol", "Albuterol", "high", "present", None, None),
    (10, "problem", "hypertension", "HTN", "medium", "present", None, None),
    (10, "problem", "chronic obstructive pulmonary disease", "COPD", "high", "present", None, None),
    (10, "symptom", "chest pain", "chest pain", "high", "absent", None, None),
    (10, "problem", "knee pain", "knee pain", "high", "present", None, "right"),
    (10, "problem", "knee pain", "right knee pain", "high", "present", None, "right"),
    (10, "problem", "asthma", "asthma", "high", "present", "past", None),
    (10, "plan", "follow up", "f/u", "medium", "planned", None, None),
    (11, "symptom", "fever", "fever", "high", "absent", None, None),
    (11, "symptom", "cough", "cough", "high", "absent", None, None),
    (11, "lab", "complete blood count", "CBC", "medium", "ordered", None, None),
    (11, "problem", "hip pain", "hip pain", "high", "present", None, "bilateral"),
    (11, "symptom", "dizziness", "dizzy", "high", "present", None, "bilateral"),
]


def _number() -> str:
    return f"CAST(event_id % {len(TEMPLATES)} AS INT)"


def _cases() -> str:
    return " ".join(f"WHEN {k} THEN {filled(t)}" for k, t in enumerate(TEMPLATES))


def wide_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, template_id, text), one note an event."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id")
    return events.selectExpr("event_id AS note_id", f"{_number()} AS template_id", f"CASE {_number()} {_cases()} END AS text")


def wide_sql() -> str:
    return f"SELECT event_id AS note_id, event_id, {_number()} AS template_id, CASE {_number()} {_cases()} END AS text FROM events"


def _sql(x: str | None) -> str:
    return "CAST(NULL AS STRING)" if x is None else filled(x)


def family_truth_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT note_id, {literal(kind)} AS entity_type, {literal(name)} AS canonical_name, {filled(text)} AS text, CAST(strpos(text, {filled(text)}) - 1 AS INT) AS start_char, {_sql(value)} AS value, {_sql(unit)} AS unit, {_sql(assertion)} AS assertion, {_sql(detail)} AS detail FROM wide WHERE template_id = {k}"
        for k, kind, name, text, value, unit, assertion, detail in FAMILY_TRUTH
    )


def dictionary_truth_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT note_id, {literal(kind)} AS entity_type, {literal(name)} AS canonical_name, {literal(text)} AS text, CAST(strpos(text, {literal(text)}) - 1 AS INT) AS start_char, {literal(level)} AS confidence, {literal(assertion)} AS assertion, {_sql(time)} AS temporality, {_sql(side)} AS laterality FROM wide WHERE template_id = {k}"
        for k, kind, name, text, level, assertion, time, side in DICTIONARY_TRUTH
    )
