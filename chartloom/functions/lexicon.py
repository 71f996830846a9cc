"""Fixed values of the rules: concepts, trigger phrases, terms and codes."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Concept:
    """groups names the pattern's capture groups, which become attributes."""

    entity_type: str
    pattern: str
    normalized_text: str
    groups: tuple[str, ...] = ()
    attributes: dict[str, str] = field(default_factory=dict)
    section: str | None = None
    confidence: float = 0.92


# The deterministic concepts.
CONCEPTS = (
    Concept("vital", r"(?i)\b(?:HR|heart rate)\s*(?:=|:)?\s*(\d{2,3})\b", "heart rate", ("value",), {"measurement": "heart-rate", "unit": "beats/min"}, "vitals"),
    Concept("vital", r"(?i)\b(?:BP|blood pressure)\s*(?:=|:)?\s*(\d{2,3})/(\d{2,3})\b", "blood pressure", ("systolic", "diastolic"), {"measurement": "blood-pressure", "unit": "mmHg"}, "vitals"),
    Concept("score", r"(?i)\bPHQ-?9\s*(?:=|:)?\s*(\d{1,2})\b", "PHQ-9", ("value",), {"scale": "PHQ-9"}),
    Concept("severity", r"(?i)\bpain\s*(?:=|:)?\s*(\d{1,2})/10\b", "pain rating", ("value",), {"scale": "0-10"}),
    Concept("risk", r"(?i)\bSI\b|\bsuicidal ideation\b", "suicidal ideation", confidence=0.86),
)

# Cues that give the bare abbreviation SI its psychiatric reading.
PSYCH_CONTEXT = r"(?i)\b(?:suicid\w*|ideation|self[-\s]?harm|homicid\w*|hopeless\w*|depress\w*|mood|phq|gad|c-?ssrs|safety plan|anxiet\w*|panic|mdd|ptsd|psych\w*|\bhi\b|overdose)\b"
SI_CONFIDENCE = 0.4

# Phrases that scope an assertion.
PRE_NEGATION = ("denies", "denied", "no", "not", "without", "w/o", "negative for", "free of", "absence of")
POST_NEGATION = ("is denied", "are denied", "denied")
HYPOTHETICAL = (
    "rule out", "r/o", "evaluate for", "monitor for", "concern for", "if develops", "watch for", "if", "in case of", "educated on",
    "education on", "warning signs of", "return precautions for", "precautions for", "instructed to report",
)
FAMILY_HISTORY = (
    "family history of", "family history", "family hx", "fhx", "mother", "father", "brother", "sister", "sibling", "maternal",
    "paternal", "grandmother", "grandfather", "aunt", "uncle", "son", "daughter",
)
HISTORICAL = ("history of", "hx of", "h/o", "status post", "s/p", "prior", "previous", "past episode of")
POST_HISTORICAL = ("resolved", "has resolved", "had resolved")
POSSIBLE = ("possible", "probable", "likely", "presumed", "suspected", "suspect", "cannot exclude", "cannot rule out", "questionable")
TERMINATION = ("but", "however", "except", "although", "though", "yet", "nevertheless", "other than")
POST_SCOPE = 40

# Circumstances that make a mention conditional, and cues of active management.
CIRCUMSTANCE = r"(?i)\b(?:with|when|upon|during|after|on)\s+(?:exertion|exercise|activity|ambulation|stairs|standing|walking|sitting|movement|lifting|bending|weight[- ]?bearing|palpation|prolonged\s+[a-z]+)\b"
MANAGEMENT = r"(?i)\b(?:on|taking|takes|managed with|controlled (?:on|with)|stable on|continues|continuing)\s+(?!(?:admission|arrival|exam|examination|presentation|review)\b)[A-Za-z]"

# Conditions taken as chronic.
CHRONIC = (
    "hypertension", "htn", "type 2 diabetes mellitus", "type 2 diabetes", "t2dm", "diabetes", "diabetes mellitus", "dm", "hyperlipidemia",
    "hld", "asthma", "copd", "chronic obstructive pulmonary disease", "ckd", "chronic kidney disease", "chf", "congestive heart failure",
    "heart failure", "major depressive disorder", "mdd", "depression", "generalized anxiety disorder", "gad", "osteoarthritis",
    "hypothyroidism",
)

# Phrases that call for a language model.
AMBIGUOUS = ("family history", "mother", "father", "sister", "brother", "concern for", "rule out", "complex", "unclear", "differential")

# Codes of the deterministic concepts (canonical name, entity type, system, code, display, confidence).
STARTER_CODES = (
    ("heart rate", "vital", "http://loinc.org", "8867-4", "Heart rate", 0.9),
    ("blood pressure", "vital", "http://loinc.org", "85354-9", "Blood pressure panel", 0.9),
    ("PHQ-9", "score", "http://loinc.org", "44261-6", "PHQ-9 total score", 0.9),
    ("pain rating", "severity", "http://loinc.org", "72514-3", "Pain severity 0-10 score", 0.8),
    ("suicidal ideation", "risk", "http://snomed.info/sct", "6471006", "Suicidal thoughts", 0.8),
)

# Section headings and their names.
SECTIONS = {
    "chief complaint": "chief-complaint",
    "cc": "chief-complaint",
    "hpi": "history-of-present-illness",
    "history of present illness": "history-of-present-illness",
    "ros": "review-of-systems",
    "review of systems": "review-of-systems",
    "pmh": "past-medical-history",
    "past medical history": "past-medical-history",
    "med": "medications",
    "meds": "medications",
    "medications": "medications",
    "allergy": "allergies",
    "allergies": "allergies",
    "social hx": "social-history",
    "social history": "social-history",
    "family hx": "family-history",
    "fhx": "family-history",
    "family history": "family-history",
    "subjective": "subjective",
    "objective": "objective",
    "assessment": "assessment",
    "plan": "plan",
    "a/p": "assessment-plan",
    "assessment/plan": "assessment-plan",
}
HEADING = r"(?i)(^|\n)\s*(chief complaint|cc|hpi|history of present illness|ros|review of systems|pmh|past medical history|meds?|medications|allergies?|social hx|social history|family hx|fhx|family history|subjective|objective|assessment|plan|a/p|assessment/plan)\s*(?::|\n|\z)"

# The logistic risk model (feature, weight, center, scale), its intercept and thresholds.
RISK_FEATURES = (
    ("entity_count", 0.802, 0.0, 20.0),
    ("problem_count_present", 0.9442, 0.0, 8.0),
    ("medication_count", 0.4902, 0.0, 6.0),
    ("plan_count", 0.7986, 0.0, 6.0),
    ("functional_limitation_count", 1.1744, 0.0, 4.0),
    ("high_priority_count", 1.6112, 0.0, 4.0),
    ("pain_rating__last", 1.1603, 0.0, 10.0),
    ("pain_rating__missing", 0.5558, 0.0, 1.0),
    ("heart_rate__mean", 1.1429, 80.0, 40.0),
    ("heart_rate__missing", 0.6409, 0.0, 1.0),
    ("bp_systolic__last", 0.9101, 120.0, 60.0),
    ("bp_diastolic__last", 0.7203, 75.0, 40.0),
    ("bp_missing", 0.6409, 0.0, 1.0),
    ("phq9__max", 1.3345, 0.0, 27.0),
    ("phq9__missing", -0.2146, 0.0, 1.0),
    ("gad7__max", 0.9308, 0.0, 21.0),
    ("si__present", 0.2307, 0.0, 1.0),
    ("si__explicitly_negated", -0.8684, 0.0, 1.0),
)
RISK_INTERCEPT, RISK_DECISION, RISK_LOW, RISK_HIGH = -2.9749, 0.5, 0.35, 0.65
