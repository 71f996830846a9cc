"""Notes as a table: the derived `clinical_notes` view over events, its gold table, and JSON Lines notes.

The driver's tables hold no clinical words, so notes are derived from events: each event_id picks one of TEMPLATES, and
integers made from it fill the blanks.  The SQL that builds a note is plain enough to run unchanged in other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks of the templates: SQL integer expressions over event_id, each of fixed width.
BLANKS = {
    "hr": "60 + event_id % 40",
    "hr2": "62 + event_id % 30",
    "sys": "110 + event_id % 40",
    "dia": "60 + event_id % 30",
    "pain": "event_id % 10",
    "phq": "10 + event_id % 10",
    "low": "event_id % 10",
    "wk": "2 + event_id % 6",
    "mg": "10 * (1 + event_id % 8)",
}

#: Texts by template number; {name} is a blank, \n a line end.
TEMPLATES = [
    "Vitals: HR {hr}, BP {sys}/{dia}. Patient denies SI.",
    "PHQ-9 {phq}. Mood is low. No suicidal ideation.",
    "Pain {pain}/10 with exertion. HR {hr}.",
    "Mother reported SI last year. BP {sys}/{dia}.",
    "History of suicidal ideation. PHQ9: {low}.",
    "Rule out SI given low mood. Pain {pain}/10.",
    "Possible SI noted. HR={hr}",
    "SI is denied today. BP {sys}/{dia}.",
    "SI has resolved. Mood stable. HR {hr}.",
    "No history of SI. Depression screening PHQ-9: {low}.",
    "Denies SI.\nLater reports SI with a plan. Mood is poor.",
    "Denies fever but SI is present. Anxiety noted.",
    "SI was discussed at length with the treating team today and was later denied. HR {hr}.",
    "Not only SI but also pain {pain}/10 reported.",
    "Follow up in {wk} weeks. Nothing else today.",
    "Chief Complaint: pain {pain}/10\nAssessment: complex presentation, unclear cause.\nPlan: monitor for SI.",
    "No possible SI today. PHQ-9 {low}.",
    "If SI develops, call. HR {hr}, BP {sys}/{dia}, pain {pain}/10.",
    "Family history of SI in brother. Denies pain {pain}/10.",
    "HR {hr}. HR {hr2} on recheck. BP {sys}/{dia}.",
    "HPI: 54 year old with HTN. Seen in clinic for {wk} weeks of cough.\nMedications: lisinopril {mg} mg daily\nPlan: follow up.",
    "Subjective: right knee pain {pain}/10 for {wk} weeks.\nObjective: gait antalgic, TUG 14 sec.\nA/P: PT 2x/week.",
]

#: (template, mention text, entity type, canonical name, assertion, decision, trigger, which occurrence of the text), written
#: by hand from the rules: an expectation that no regular expression has part in.
GOLD = [
    (0, "HR {hr}", "vital", "heart rate", "present", "default-present", None, 1),
    (0, "BP {sys}/{dia}", "vital", "blood pressure", "present", "default-present", None, 1),
    (0, "SI", "risk", "suicidal ideation", "absent", "pre-negation", "denies", 1),
    (1, "PHQ-9 {phq}", "score", "PHQ-9", "present", "default-present", None, 1),
    (1, "suicidal ideation", "risk", "suicidal ideation", "absent", "pre-negation", "No", 1),
    (2, "Pain {pain}/10", "severity", "pain rating", "conditional", "conditional", "with exertion", 1),
    (2, "HR {hr}", "vital", "heart rate", "present", "default-present", None, 1),
    (3, "SI", "risk", "suicidal ideation", "family-history", "family-history", "Mother", 1),
    (3, "BP {sys}/{dia}", "vital", "blood pressure", "present", "default-present", None, 1),
    (4, "suicidal ideation", "risk", "suicidal ideation", "historical", "historical", "History of", 1),
    (4, "PHQ9: {low}", "score", "PHQ-9", "present", "default-present", None, 1),
    (5, "SI", "risk", "suicidal ideation", "hypothetical", "hypothetical", "Rule out", 1),
    (5, "Pain {pain}/10", "severity", "pain rating", "present", "default-present", None, 1),
    (6, "SI", "risk", "suicidal ideation", "possible", "possible", "Possible", 1),
    (6, "HR={hr}", "vital", "heart rate", "present", "default-present", None, 1),
    (7, "SI", "risk", "suicidal ideation", "absent", "post-negation", "is denied", 1),
    (7, "BP {sys}/{dia}", "vital", "blood pressure", "present", "default-present", None, 1),
    (8, "SI", "risk", "suicidal ideation", "historical", "post-historical", "has resolved", 1),
    (8, "HR {hr}", "vital", "heart rate", "present", "default-present", None, 1),
    (9, "SI", "risk", "suicidal ideation", "absent", "pre-negation", "No history of", 1),
    (9, "PHQ-9: {low}", "score", "PHQ-9", "present", "default-present", None, 1),
    (10, "SI", "risk", "suicidal ideation", "absent", "pre-negation", "Denies", 1),
    (10, "SI", "risk", "suicidal ideation", "present", "default-present", None, 2),
    (11, "SI", "risk", "suicidal ideation", "present", "default-present", None, 1),
    (12, "SI", "risk", "suicidal ideation", "unknown", "unresolved", "denied", 1),
    (12, "HR {hr}", "vital", "heart rate", "present", "default-present", None, 1),
    (13, "SI", "risk", "suicidal ideation", "present", "default-present", None, 1),
    (13, "pain {pain}/10", "severity", "pain rating", "present", "default-present", None, 1),
    (15, "pain {pain}/10", "severity", "pain rating", "present", "default-present", None, 1),
    (15, "SI", "risk", "suicidal ideation", "hypothetical", "hypothetical", "monitor for", 1),
    (16, "SI", "risk", "suicidal ideation", "possible", "possible", "possible", 1),
    (16, "PHQ-9 {low}", "score", "PHQ-9", "present", "default-present", None, 1),
    (17, "SI", "risk", "suicidal ideation", "hypothetical", "hypothetical", "If", 1),
    (17, "HR {hr}", "vital", "heart rate", "present", "default-present", None, 1),
    (17, "BP {sys}/{dia}", "vital", "blood pressure", "present", "default-present", None, 1),
    (17, "pain {pain}/10", "severity", "pain rating", "present", "default-present", None, 1),
    (18, "SI", "risk", "suicidal ideation", "family-history", "family-history", "Family history of", 1),
    (18, "pain {pain}/10", "severity", "pain rating", "absent", "pre-negation", "Denies", 1),
    (19, "HR {hr}", "vital", "heart rate", "present", "default-present", None, 1),
    (19, "HR {hr2}", "vital", "heart rate", "present", "default-present", None, 1),
    (19, "BP {sys}/{dia}", "vital", "blood pressure", "present", "default-present", None, 1),
    (21, "pain {pain}/10", "severity", "pain rating", "present", "default-present", None, 1),
]


#: Rows of a table of notes that one task takes.
NOTES_A_TASK = 10_000


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str) -> str:
    """SQL of a text with blanks."""
    pieces: list[str] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        lines = head.split("\n")
        for i, line in enumerate(lines):
            if i:
                pieces.append("chr(10)")
            if line:
                pieces.append(literal(line))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(f"CAST({BLANKS[name]} AS STRING)")
    return "concat(" + ", ".join(pieces) + ")"


def notes_sql() -> str:
    """SELECT over a table `events`, in SQL that Spark and DuckDB read alike."""
    cases = " ".join(f"WHEN {k} THEN {filled(t)}" for k, t in enumerate(TEMPLATES))
    number = f"CAST(event_id % {len(TEMPLATES)} AS INT)"
    return f"SELECT event_id AS note_id, user_id AS patient_id, event_id AS visit_id, ts AS observed_at, {number} AS template_id, CASE {number} {cases} END AS text FROM events"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, and over a partition for each NOTES_A_TASK rows, where its files give fewer: what follows is costly a row,
    the rows are small, and a packed file of few blocks would be few tasks however many rows it has.

    Dealt by keys, rows need no further shuffle to be grouped by them, and no task of the grouping grows with the table either.
    A table of many files keeps its partitions and has no shuffle here.  The count reads the files' footers.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // NOTES_A_TASK))
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df


def clinical_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, patient_id, visit_id, observed_at, template_id, text), one note an event."""
    number = f"CAST(event_id % {len(TEMPLATES)} AS INT)"
    cases = " ".join(f"WHEN {k} THEN {filled(t)}" for k, t in enumerate(TEMPLATES))
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts"), "event_id")
    return events.selectExpr("event_id AS note_id", "user_id AS patient_id", "event_id AS visit_id", "ts AS observed_at", f"{number} AS template_id", f"CASE {number} {cases} END AS text")


def gold_sql() -> str:
    """The expected mentions of every note, for another engine: needs a table `notes` made by notes_sql() and `events`."""
    parts = []
    for k, (template, text, kind, name, assertion, decision, trigger, nth) in enumerate(GOLD):
        sql = filled(text)
        start = f"strpos(n.text, {sql}) - 1" if nth == 1 else f"strpos(n.text, {sql}) + strpos(substr(n.text, strpos(n.text, {sql}) + 1), {sql}) - 1"
        parts.append(
            f"SELECT n.note_id, n.patient_id, n.observed_at, {k} AS gold_ord, {literal(kind)} AS entity_type, {sql} AS text, {literal(name)} AS normalized_text, "
            f"CAST({start} AS INT) AS start_char, CAST({start} + length({sql}) AS INT) AS end_char, {literal(assertion)} AS assertion, {literal(decision)} AS decision, "
            f"{literal(trigger) if trigger else 'CAST(NULL AS STRING)'} AS trigger_text FROM notes n JOIN events e ON n.note_id = e.event_id WHERE n.template_id = {template}"
        )
    return " UNION ALL ".join(parts)


def gold_mentions(notes: DataFrame, events: DataFrame) -> DataFrame:
    """The expected mentions as a table: (note_id, gold_idx, entity_type, text, normalized_text, start_char, end_char, assertion)."""
    rows = notes.join(events.select(F.col("event_id")), notes["note_id"] == F.col("event_id"))
    each = []
    for k, (template, text, kind, name, assertion, _, _, nth) in enumerate(GOLD):
        found = F.expr(filled(text))
        at = F.expr(f"locate({filled(text)}, text, {1 if nth == 1 else f'locate({filled(text)}, text) + 1'})") - 1
        one = F.struct(F.lit(k).alias("gold_ord"), F.lit(kind).alias("entity_type"), found.alias("text"), F.lit(name).alias("normalized_text"), at.cast("int").alias("start_char"), (at + F.length(found)).cast("int").alias("end_char"), F.lit(assertion).alias("assertion"))
        each.append((template, one))
    empty = None
    by_template = F.lit(None)
    for k in range(len(TEMPLATES)):
        own = [one for t, one in each if t == k]
        if own:
            empty = F.when(F.col("template_id") == k, F.array(*own)) if empty is None else empty.when(F.col("template_id") == k, F.array(*own))
    by_template = empty
    return rows.select("note_id", "patient_id", F.explode(by_template).alias("g")).select("note_id", "patient_id", "g.*")


GOLD_SCHEMA = "source_id string, text string, mentions array<struct<text: string, entity_type: string, start_char: int, end_char: int, assertion: string>>"


def read_gold_notes(spark: SparkSession, folder: str) -> DataFrame:
    """JSON Lines notes with gold mentions; blank lines are skipped."""
    return spark.read.schema(GOLD_SCHEMA).json(folder)


def checked_gold_mentions(gold: DataFrame) -> DataFrame:
    """One row a gold mention; a span that does not reproduce the mention's text raises."""
    rows = gold.select("source_id", F.col("text").alias("note_text"), F.posexplode("mentions").alias("gold_idx", "m"))
    found = F.expr("substring(note_text, m.start_char + 1, m.end_char - m.start_char)")
    checked = F.when(found == F.col("m.text"), F.col("m.text")).otherwise(F.raise_error(F.concat(F.lit("span does not reproduce the mention in "), F.col("source_id"))))
    return rows.select("source_id", "gold_idx", checked.alias("text"), "m.entity_type", "m.start_char", "m.end_char", "m.assertion")
