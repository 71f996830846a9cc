"""What kind of note this is: specialty scores, primary and active specialties, note type, ambiguous abbreviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.spans import let, match_spans
from chartloom.operators.sections import sections

PC, MH, PT, MX = "primary-care", "mental-health", "physical-therapy", "mixed"

# Words that speak for a specialty (pattern, specialty, weight).
LEXICAL = (
    (r"(?i)\b(?:HTN|T2DM|DM|HLD|A1c|CBC|CMP|BMP|LDL|HDL|BP|HR|SpO2|COPD|CAD|CHF|CKD|OSA)\b", PC, 2),
    (r"(?i)\b(?:lisinopril|metformin|atorvastatin|amlodipine|losartan|levothyroxine|albuterol)\b", PC, 1),
    (r"(?i)\b(?:PHQ-?9|GAD-?7|SI|HI|AVH|MDD|PTSD|CBT|DBT|safety plan|anhedonia|low mood|panic|hypomania)\b", MH, 2),
    (r"(?i)\b(?:sertraline|fluoxetine|escitalopram|bupropion|duloxetine)\b", MH, 1),
    (r"(?i)\b(?:ROM|AROM|PROM|HEP|MMT|TUG|5xSTS|SLR|Hawkins|Neer|McMurray|Lachman|FABER|WBAT|NWB|RLE|LLE|RUE|LUE)\b", PT, 2),
    (r"(?i)\b(?:gait|balance|overhead reach|stairs|manual muscle|range of motion|home exercise)\b", PT, 1),
    (r"(?i)\b(?:SLP|ST|AAC|MBSS|VFSS|dysphagia|aphasia|dysarthria|swallow|aspiration|thickened liquids)\b", PT, 2),
)
# Sections that speak for a specialty, where the note holds such a word.
SECTIONAL = (
    (("medications", "allergies", "past-medical-history", "family-history"), None, PC),
    (("subjective", "objective"), r"(?i)\b(ROM|AROM|PROM|HEP|gait|balance|pain)\b", PT),
    (("assessment", "plan", "assessment-plan"), r"(?i)\b(PHQ|GAD|SI|HI|CBT|DBT|mood|anxiety)\b", MH),
)
# Note types, the first that applies.
NOTE_TYPES = ((r"(?i)\b(subjective|objective|assessment|plan)\s*:", "soap"), (r"(?i)\b(eval|evaluation|initial evaluation)\b", "eval"), (r"(?i)\b(progress note|daily note|follow[- ]?up)\b", "progress-note"))
# Abbreviations with more than one reading: (meaning, canonical name or None, specialties, hints).
AMBIGUOUS = {
    "PT": (("patient", None, (PC, MH, PT, MX), ("reports", "endorses", "denies", "states", "presents")), ("physical therapy", "physical therapy", (PT, MX), ("referral", "HEP", "ROM", "therapy"))),
    "OT": (("occupational therapy", "occupational therapy", (PT, MX), ("referral", "ADL", "therapy", "splint")), ("ear", None, (PC, MX), ("ear", "otitis", "ENT"))),
    "CP": (("chest pain", "chest pain", (PC, MX), ("SOB", "cardiac", "denies", "BP")), ("cerebral palsy", "cerebral palsy", (PC, PT, MX), ("developmental", "spasticity", "pediatric"))),
    "CA": (("cancer", "cancer", (PC, MX), ("oncology", "carcinoma", "metastasis", "tumor")), ("cardiac arrest", "cardiac arrest", (PC, MX), ("resuscitation", "CPR", "arrest", "ROSC"))),
    "SI": (("suicidal ideation", "suicidal ideation", (MH, MX), ("HI", "PHQ-9", "risk", "denies")), ("stroke index", None, (PC, MX), ("cardiac", "hemodynamic"))),
    "ROM": (("range of motion", "range of motion", (PT, MX), ("AROM", "PROM", "flex", "HEP")), ("rupture of membranes", None, (PC, MX), ("OB", "pregnancy", "labor")), ("right otitis media", None, (PC, MX), ("ear", "otitis", "pediatric"))),
    "DC": (("discharge", "discharge", (PC, MH, PT, MX), ("home", "hospital", "SNF")), ("discontinue", "discontinue medication", (PC, MH, MX), ("medication", "stop", "hold"))),
    "d/c": (("discontinue", "discontinue medication", (PC, MH, MX), ("medication", "stop", "hold")), ("discharge", "discharge", (PC, PT, MX), ("home", "SNF", "hospital"))),
}
# Specialties that a resolved abbreviation speaks for.
HINTS = {
    "physical therapy": (PT,), "range of motion": (PT,), "suicidal ideation": (MH,), "chest pain": (PC,), "cerebral palsy": (PC, PT), "occupational therapy": (PT,), "cancer": (PC,), "cardiac arrest": (PC,),
}
WINDOW = 90


def note_type(text: Column) -> Column:
    out = None
    for pattern, name in NOTE_TYPES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("unknown")


def section_names(text: Column) -> Column:
    return F.transform(sections(text), lambda s: s["name"])


def specialty_scores(text: Column, names: Column | None = None) -> dict[str, Column]:
    """Score of each specialty from the note's words and sections (names: those of its sections, where they are at hand)."""
    names = section_names(text) if names is None else names
    out: dict[str, Column] = {}
    for specialty in (PC, MH, PT):
        score = F.lit(0)
        for pattern, own, weight in LEXICAL:
            if own == specialty:
                score = score + F.when(text.rlike(pattern), weight).otherwise(0)
        for kinds, pattern, own in SECTIONAL:
            if own == specialty:
                n = F.size(F.filter(names, _one_of(kinds)))
                score = score + (F.when(text.rlike(pattern), n).otherwise(0) if pattern else n)
        out[specialty] = score
    return out


def _one_of(kinds: tuple[str, ...]):
    return lambda x: x.isin(*kinds)


def primary_specialty(pc: Column, mh: Column, pt: Column) -> Column:
    """The specialty of the highest score; mixed where there is none, or where the next is within one of it."""

    def named(v: Column) -> Column:
        ranked = F.sort_array(v, asc=False)
        top, second = ranked[0], ranked[1]
        leader = F.when(v[0] == top, PC).when(v[1] == top, MH).otherwise(PT)
        return F.when(top == 0, MX).when((second > 0) & (top - second <= 1), MX).otherwise(leader)

    return let(F.array(pc, mh, pt), named)


def resolved_abbreviation(text: Column, abbreviation: str, primary: Column, lowered: Column | None = None) -> Column:
    """struct<n, meaning, canonical_name, score> of an ambiguous abbreviation; null where the note does not hold it.

    A reading scores three for each hint near a mention, one for each elsewhere, and one where it fits the primary
    specialty.  A tie above one leaves it open; without any score the first reading of the specialty is taken.
    """
    escaped = "".join("\\" + c if c in "/" else c for c in abbreviation)
    low = F.lower(text) if lowered is None else lowered
    found = match_spans(text, f"(?i)(?<![A-Za-z0-9]){escaped}(?![A-Za-z0-9])", lowered=low)

    def resolved(v: Column) -> Column:
        def window(m: Column) -> Column:
            first = F.greatest(F.lit(0), m["start"] - WINDOW)
            return low.substr(first + 1, m["end"] + WINDOW - first)

        return let(F.transform(v, window), lambda near: let(_ranked(near, low, abbreviation, primary), lambda r: _chosen(r, v, abbreviation, primary)))

    return let(found, lambda v: F.when(F.size(v) > 0, resolved(v)))


def _ranked(near: Column, low: Column, abbreviation: str, primary: Column) -> Column:
    choices = []
    for k, (meaning, name, specialties, hints) in enumerate(AMBIGUOUS[abbreviation]):
        score = F.when(primary.isin(*specialties), 1).otherwise(0)
        for hint in hints:
            score = score + F.when(F.exists(near, _holds(hint.lower())), 3).when(F.contains(low, F.lit(hint.lower())), 1).otherwise(0)
        choices.append(F.struct((-score).alias("rank"), F.lit(k).alias("ord"), F.lit(meaning).alias("meaning"), F.lit(name).cast("string").alias("canonical_name")))
    return F.array_sort(F.array(*choices))


def _chosen(ranked: Column, spans: Column, abbreviation: str, primary: Column) -> Column:
    open_ = (ranked[0]["rank"] == ranked[1]["rank"]) & (ranked[0]["rank"] < -1)
    fallback = None
    for meaning, name, specialties, _ in AMBIGUOUS[abbreviation]:
        own = F.struct(F.lit(meaning).alias("meaning"), F.lit(name).cast("string").alias("canonical_name"))
        fallback = F.when(primary.isin(*specialties), own) if fallback is None else fallback.when(primary.isin(*specialties), own)
    best = F.struct(ranked[0]["meaning"].alias("meaning"), ranked[0]["canonical_name"].alias("canonical_name"))
    chosen = F.when(open_, F.lit(None)).when(ranked[0]["rank"] < 0, best).otherwise(fallback)
    return let(chosen, lambda c: F.struct(F.lit(abbreviation).alias("abbreviation"), F.size(spans).alias("n"), c["meaning"].alias("meaning"), c["canonical_name"].alias("canonical_name")))


def _holds(hint: str):
    return lambda w: F.contains(w, F.lit(hint))


def note_context(notes: DataFrame) -> DataFrame:
    """(note_id, note_type, pc, mh, pt, primary_specialty, abbreviations, active_specialties): one row a note."""
    return _contexts(notes).drop("text")


def _contexts(notes: DataFrame) -> DataFrame:
    s = specialty_scores(F.col("text"), F.col("_names"))
    rows = notes.select("note_id", "text", section_names(F.col("text")).alias("_names"))
    rows = rows.select("note_id", "text", note_type(F.col("text")).alias("note_type"), *[c.alias(n) for c, n in zip(s.values(), ("pc", "mh", "pt"), strict=True)])
    rows = rows.withColumn("primary_specialty", primary_specialty(F.col("pc"), F.col("mh"), F.col("pt")))
    both = F.struct(F.col("primary_specialty").alias("p"), F.col("text").alias("t"), F.lower("text").alias("low"))
    rows = rows.withColumn("abbreviations", let(both, lambda v: F.array_compact(F.array(*[resolved_abbreviation(v["t"], a, v["p"], v["low"]) for a in AMBIGUOUS]))))
    active = [F.lit(MX)]
    for specialty, column in ((PC, "pc"), (MH, "mh"), (PT, "pt")):
        names = [n for n, own in HINTS.items() if specialty in own]
        hinted = F.size(F.filter("abbreviations", _named(tuple(names))))
        active.append(F.when(F.col(column) + hinted > 0, F.lit(specialty)))
    return rows.withColumn("active_specialties", F.array_compact(F.array(*active)))


def note_abbreviations(notes: DataFrame, keep: Sequence[str] = ("note_id",)) -> DataFrame:
    """(note_id, place, abbreviation, n, meaning, canonical_name): one row an ambiguous abbreviation of a note, in order.

    keep: columns of the note that each row carries, note_id and text at most.
    """
    # the outer form: for the inner one, Catalyst would resolve all abbreviations a second time, before notes are dealt, to drop notes without any
    rows = _contexts(notes).select(*keep, F.posexplode_outer("abbreviations").alias("place", "a")).where("a IS NOT NULL")
    return rows.select(*keep, "place", "a.*")


def _named(names: tuple[str, ...]):
    return lambda a: F.coalesce(a["canonical_name"].isin(*names), F.lit(False))
