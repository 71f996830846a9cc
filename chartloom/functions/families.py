"""Pattern families of the wide vocabulary: fixed patterns, and what their groups mean.

Each family scans a note by one pattern.  `build` gets the match (struct with text and g1..gn) and gives the canonical name
and the attributes; names that depend on the match are looked up in small fixed maps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = ("primary-care", "mental-health", "physical-therapy", "mixed")
PC, MH, PT, MX = ALL

# Names and units behind the abbreviations that patterns capture.
LAB_NAMES = {
    "hgb": "hemoglobin", "hb": "hemoglobin", "wbc": "white blood cell count", "plt": "platelet count", "platelets": "platelet count", "tsh": "thyroid stimulating hormone",
    "cr": "creatinine", "creatinine": "creatinine", "egfr": "estimated glomerular filtration rate", "ldl": "low density lipoprotein cholesterol", "hdl": "high density lipoprotein cholesterol",
    "tg": "triglycerides", "triglycerides": "triglycerides", "total cholesterol": "total cholesterol", "tc": "total cholesterol",
}
LAB_UNITS = {
    "hemoglobin": "g/dL", "white blood cell count": "k/uL", "platelet count": "k/uL", "triglycerides": "mg/dL", "creatinine": "mg/dL", "estimated glomerular filtration rate": "mL/min/1.73m2",
    "thyroid stimulating hormone": "uIU/mL", "low density lipoprotein cholesterol": "mg/dL", "high density lipoprotein cholesterol": "mg/dL", "total cholesterol": "mg/dL",
}
DOSE_UNITS = {"tablets": "tablet", "tabs": "tab", "caps": "cap", "puffs": "puff", "units": "unit"}
ROUTES = {"by mouth": "PO", "oral": "PO", "sc": "SQ"}
FREQUENCIES = {"qday": "daily", "qd": "daily", "qam": "every morning", "qpm": "every evening", "qhs": "at bedtime", "bid": "twice daily", "tid": "three times daily", "qid": "four times daily"}
SUBSTANCES = {"pcn": "penicillin", "sulfonamide": "sulfa", "sulfonamides": "sulfa", "peanuts": "peanut"}
CONDITIONS = {"dm": "diabetes mellitus", "diabetes": "diabetes mellitus", "cad": "heart disease"}
MODALITIES = {"cxr": "x-ray", "chest x-ray": "x-ray", "xr": "x-ray", "x-ray": "x-ray", "us": "ultrasound"}
REFERRALS = {"pt": "physical therapy", "psych": "psychiatry", "ortho": "orthopedics"}

_KIN = "mother|father|sister|brother|parent|maternal grandmother|paternal grandmother|maternal grandfather|paternal grandfather"
_ILL = "diabetes|DM|colon cancer|breast cancer|heart disease|CAD|depression|bipolar disorder"
_SPAN = "days?|wks?|weeks?|mos?|months?|years?|yrs?"


def looked_up(key: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(key)), otherwise if otherwise is not None else F.lower(key))


def _absent(c: Column) -> Column:
    return F.when(F.coalesce(F.lower(F.trim(c)).isin("denies", "no", "none", "never"), F.lit(False)), "absent").otherwise("present")


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def _sig(dose: Column, route: Column, frequency: Column, prn: Column, indication: Column) -> Column:
    return _joined(dose, route, frequency, F.when(prn.isNotNull(), "as needed"), F.when(indication.isNotNull(), F.concat(F.lit("for "), indication)))


def _imaging_name(m: Column) -> Column:
    site = F.coalesce(_site(m["g3"]), F.when(F.lower(m["g2"]) == "cxr", "chest"))
    return _joined(site, looked_up(m["g2"], MODALITIES, F.upper(m["g2"])))


def _site(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[.。]+$", ""), r"\s+", " ")))


Built = dict[str, Column]


@dataclass(frozen=True)
class Family:
    entity_type: str
    name: str
    pattern: str
    groups: int
    specialties: tuple[str, ...]
    build: Callable[[Column], Built]  # name (optional), value, unit, assertion, detail


def _value(unit: str | None = None, group: int = 1) -> Callable[[Column], Built]:
    return lambda m: {"value": m[f"g{group}"], "unit": F.lit(unit).cast("string")}


def _plain(assertion: str | None = None) -> Callable[[Column], Built]:
    return lambda m: {"assertion": F.lit(assertion).cast("string")}


def _said(m: Column) -> Built:
    return {"value": F.lower(m["g1"])}


# The patterns.
FAMILIES = (
    Family("score", "Patient Health Questionnaire-9", r"\bPHQ-?9\s*(?:=|:)?\s*(\d{1,2})\b", 1, (MH, MX), _value()),
    Family("score", "Generalized Anxiety Disorder-7", r"\bGAD-?7\s*(?:=|:)?\s*(\d{1,2})\b", 1, (MH, MX), _value()),
    Family("score", "Alcohol Use Disorders Identification Test-Consumption", r"\bAUDIT-?C\s*(?:=|:)?\s*(\d{1,2})\b", 1, (PC, MH, MX), _value()),
    Family("score", "Columbia Suicide Severity Rating Scale", r"\bC-?SSRS\s*(?:=|:)?\s*(\d{1,2})\b", 1, (MH, MX), _value()),
    Family("lab", "hemoglobin A1c", r"\bA1c\s*(?:=|:)?\s*(\d+(?:\.\d+)?)\b", 1, (PC, MX), _value("%")),
    Family(
        "lab", "lab value",
        r"\b(Hgb|Hb|WBC|Plt|platelets|TSH|Cr|creatinine|eGFR|LDL|HDL|TG|triglycerides|total cholesterol|TC)\s*(?:=|:)?\s*(\d+(?:\.\d+)?)\s*(g/dL|k/uL|x10\^3/uL|mg/dL|mL/min(?:/1\.73m2)?|uIU/mL)?\b",
        3, ALL, lambda m: {"name": looked_up(m["g1"], LAB_NAMES), "value": m["g2"], "unit": F.coalesce(m["g3"], looked_up(looked_up(m["g1"], LAB_NAMES), LAB_UNITS, F.lit(None).cast("string")))},
    ),
    Family("vital", "body mass index", r"\bBMI\s*(?:=|:)?\s*(\d+(?:\.\d+)?)\b", 1, (PC, MX), _value()),
    Family("vital", "blood pressure", r"\b(?:BP|blood pressure)\s*(?:=|:)?\s*(\d{2,3})\s*/\s*(\d{2,3})\b", 2, ALL, lambda m: {"value": F.concat_ws("/", m["g1"], m["g2"]), "unit": F.lit("mmHg")}),
    Family("vital", "heart rate", r"\b(?:HR|heart rate|pulse)\s*(?:=|:)?\s*(\d{2,3})\s*(?:bpm|beats/min)?\b", 1, ALL, _value("beats/min")),
    Family("vital", "respiratory rate", r"\b(?:RR|respiratory rate|resp rate)\s*(?:=|:)?\s*(\d{1,3})\s*(?:/min|breaths/min)?\b", 1, ALL, _value("breaths/min")),
    Family("vital", "oxygen saturation", r"\b(?:SpO2|O2\s*sat|oxygen sat(?:uration)?|pulse ox)\s*(?:=|:)?\s*(\d{2,3})\s*%?\b", 1, ALL, _value("%")),
    Family(
        "vital", "body temperature", r"\b(?:temp(?:erature)?|T)\s*(?:=|:)?\s*(\d{2,3}(?:\.\d+)?)\s*(?:°?\s*(F|C|fahrenheit|celsius))?\b", 2, ALL,
        lambda m: {"value": m["g1"], "unit": F.when(F.lower(m["g2"]).isin("c", "celsius"), "Cel").otherwise("degF")},
    ),
    Family(
        "vital", "body weight", r"\b(?:wt|weight)\s*(?:=|:)?\s*(\d{2,3}(?:\.\d+)?)\s*(kg|kgs|lb|lbs|pounds?)?\b", 2, ALL,
        lambda m: {"value": m["g1"], "unit": F.when(F.lower(m["g2"]).isin("kg", "kgs"), "kg").when(m["g2"].isNotNull(), "lb")},
    ),
    Family("severity", "pain rating", r"\bpain\s*(?:=|:)?\s*(\d{1,2})/10\b", 1, (PT, PC, MX), lambda m: {"value": F.concat(m["g1"], F.lit("/10")), "detail": m["g1"]}),
    Family("finding", "range of motion measurement", r"\b(?:AROM|PROM|ROM)?\s*(flex|abd|abduction|flexion|ER|IR)\s*(\d{1,3})\b", 2, (PT, MX), lambda m: {"value": m["g2"], "unit": F.lit("degrees"), "detail": m["g1"]}),
    Family("finding", "manual muscle test", r"\b(ER|IR|flex|abd|ext)\s*(\d[+-]?/5)\b", 2, (PT,), lambda m: {"value": m["g2"], "detail": m["g1"]}),
    Family("functional-limitation", "Timed Up and Go", r"\b(?:TUG|Timed Up and Go)\s*(?:=|:)?\s*(\d+(?:\.\d+)?)\s*(?:sec|secs|seconds?)\b", 1, (PT, MX), _value("seconds")),
    Family("functional-limitation", "five times sit to stand", r"\b(?:5xSTS|five times sit to stand)\s*(?:=|:)?\s*(\d+(?:\.\d+)?)\s*(?:sec|secs|seconds?)\b", 1, (PT, MX), _value("seconds")),
    Family("duration", "duration", rf"\b(?:x|for)\s*(\d+)\s*({_SPAN})\b", 2, ALL, lambda m: {"value": m["g1"], "unit": m["g2"], "detail": _joined(m["g1"], m["g2"])}),
    Family("plan", "follow up", rf"\b(?:f/u|follow[- ]?up)\s+(?:in\s+)?(\d+)\s*({_SPAN})\b", 2, ALL, lambda m: {"value": _joined(m["g1"], m["g2"]), "detail": _joined(m["g1"], m["g2"])}),
    Family("plan", "treatment frequency", r"\b(?:cont|continue)?\s*(\d+)x/(wk|week|mo|month)\b", 2, (PT,), lambda m: {"value": F.concat(m["g1"], F.lit("x/"), m["g2"]), "detail": F.concat(m["g1"], F.lit("x/"), m["g2"])}),
    Family(
        "risk", "tobacco use",
        r"\b(?:(denies|no)\s+(?:tobacco|smoking)|(?:tobacco|smoking)\s*[:=]?\s*(never|none|denies|former|current|[\d.]+\s*(?:ppd|packs?/day))|smokes\s+([\d.]+)\s*(?:ppd|packs?/day))\b",
        3, ALL, lambda m: {"value": F.coalesce(m["g2"], F.concat(m["g3"], F.lit(" ppd"))), "assertion": _absent(F.coalesce(m["g1"], m["g2"]))},
    ),
    Family(
        "risk", "alcohol use",
        r"\b(?:(denies|no)\s+(?:alcohol|EtOH)|(?:EtOH|alcohol)\s*[:=]?\s*(never|none|denies|social|rare|daily|weekly|[\d.]+\s*(?:drinks?|beers?|glasses)(?:/(?:day|wk|week))?))\b",
        2, (PC, MH, MX), lambda m: {"value": m["g2"], "assertion": _absent(F.coalesce(m["g1"], m["g2"]))},
    ),
    Family("risk", "substance use", r"\b(?:uses?\s+)?(marijuana|cannabis|THC|cocaine|opioids?|methamphetamine)\s*(daily|weekly|occasionally|use)?\b", 2, (PC, MH, MX), lambda m: {"value": F.lower(m["g1"]), "detail": F.lower(m["g2"])}),
    Family(
        "risk", "family history", rf"\b(?:FHx|family history(?: of)?)\s*[:-]?\s*(?:({_KIN})\s+(?:with|has|had)\s+)?({_ILL})\b", 2, ALL,
        lambda m: {"name": F.concat(F.lit("family history of "), looked_up(m["g2"], CONDITIONS)), "assertion": F.lit("family-history"), "detail": F.lower(m["g1"])},
    ),
    Family(
        "risk", "family member history", rf"\b({_KIN})\s+(?:with|has|had)\s+({_ILL})\b", 2, ALL,
        lambda m: {"name": F.concat(F.lit("family history of "), looked_up(m["g2"], CONDITIONS)), "assertion": F.lit("family-history"), "detail": F.lower(m["g1"])},
    ),
    Family(
        "imaging", "imaging", r"\b(?:(ordered|order|reviewed|obtained)\s+)?(CXR|chest x-?ray|x-?ray|XR|MRI|CT|ultrasound|US)\s*(?:of\s+)?([a-z][a-z\s-]{1,35})?", 3, (PC, PT, MX),
        lambda m: {"name": _imaging_name(m), "assertion": F.when(F.coalesce(F.lower(m["g1"]).startswith("order"), F.lit(False)), "ordered").otherwise("present"), "detail": _site(m["g3"])},
    ),
    Family(
        "referral", "referral", r"\b(?:refer(?:ral)?(?:red)? to|referral to|consult)\s+(PT|physical therapy|psychiatry|psych|cardiology|ortho|orthopedics|neurology)\b", 1, ALL,
        lambda m: {"name": F.concat(F.lit("referral to "), looked_up(m["g1"], REFERRALS)), "assertion": F.lit("planned")},
    ),
    Family("procedure", "procedure", r"\b(colonoscopy|pap smear|joint injection|cortisone injection|steroid injection)\b", 1, (PC, PT, MX), lambda m: {"name": F.lower(m["g1"])}),
    Family("finding", "gait abnormality", r"\b(antalgic gait|impaired gait|gait instability)\b", 1, (PT, MX), _said),
    Family("functional-limitation", "impaired balance", r"\b(impaired balance|poor balance|balance deficits?)\b", 1, (PT, MX), _said),
    Family("risk", "fall risk", r"\b(fall risk|falls? risk|history of falls?)\b", 1, (PT, PC, MX), _said),
    Family("symptom", "panic attacks", r"\b(panic attacks?|panic episodes?)\b", 1, (MH, PC, MX), _plain()),
    Family("finding", "mania", r"\b(mania|manic symptoms?|hypomania|hypomanic symptoms?)\b", 1, (MH, MX), _said),
    Family("risk", "safety plan", r"\b(safety plan|crisis plan)\b", 1, (MH, MX), _plain("planned")),
    Family(
        "medication", "medication",
        r"\b(lisinopril|sertraline|metformin|ibuprofen|acetaminophen|atorvastatin|amlodipine|losartan|levothyroxine|omeprazole|fluoxetine|escitalopram|bupropion|duloxetine|gabapentin)\s+(\d+(?:\.\d+)?)\s*(mg|mcg|g|units?|tabs?|tablets?|caps?)\s*(?:(PO|oral|by mouth|IM|IV|SQ|SC|topical|SL)\s*)?(?:(daily|qday|qd|bid|tid|qid|qhs|qam|qpm|weekly|q\d+h|every\s+\d+\s+hours?|once daily|twice daily|three times daily)\s*)?(?:(PRN|as needed)\s*([a-z][a-z\s-]{1,40})?)?",
        7, (PC, MH, MX),
        lambda m: {
            "name": F.lower(m["g1"]), "value": _joined(m["g2"], looked_up(m["g3"], DOSE_UNITS)),
            "detail": _sig(_joined(m["g2"], looked_up(m["g3"], DOSE_UNITS)), looked_up(m["g4"], ROUTES, F.upper(m["g4"])), looked_up(F.trim(F.regexp_replace(m["g5"], r"\s+", " ")), FREQUENCIES), m["g6"], F.trim(m["g7"])),
        },
    ),
    Family(
        "medication", "inhaled medication", r"\b(albuterol)\s+(?:inhaler\s+)?(\d+(?:\.\d+)?)\s*(puffs?)\s*(?:(q\d+h|every\s+\d+\s+hours?)\s*)?(?:(PRN|as needed)\s*([a-z][a-z\s-]{1,40})?)?", 6, (PC, MH, MX),
        lambda m: {
            "name": F.lower(m["g1"]), "value": _joined(m["g2"], looked_up(m["g3"], DOSE_UNITS)),
            "detail": _sig(_joined(m["g2"], looked_up(m["g3"], DOSE_UNITS)), F.lit("inhaled"), looked_up(F.trim(F.regexp_replace(m["g4"], r"\s+", " ")), FREQUENCIES), m["g5"], F.trim(m["g6"])),
        },
    ),
    Family("allergy", "no known drug allergies", r"\b(?:NKDA|NKA|no known (?:drug )?allergies|denies (?:drug )?allergies)\b", 0, ALL, _plain("absent")),
    Family(
        "allergy", "allergy",
        r"\b(?:allerg(?:y|ies)(?:\s+to)?|allergic\s+to)\s*[:-]?\s*(penicillin|pcn|sulfa|sulfonamides?|latex|peanuts?|shellfish|amoxicillin)\b(?:\s*(?:-|with|causes?|caused|reaction:?|rxn:?)\s*([a-z][a-z\s/-]{2,40}))?",
        2, ALL, lambda m: {"name": F.concat(looked_up(m["g1"], SUBSTANCES), F.lit(" allergy")), "assertion": F.lit("present"), "detail": F.trim(F.regexp_replace(m["g2"], r"[.。]+$", ""))},
    ),
)
