"""Links between a note's entities, nested entities, and abbreviations attached to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.operators.adapters import relation_rules
from chartloom.operators.lineage import fixed, merged
from chartloom.operators.vocabulary import nearest

CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}
NEAR_TARGETS = ("problem", "symptom", "risk", "functional-limitation")
PLANNED = ("referral", "plan", "exercise")

# Abbreviation, reading, name of the entity, its type; those of one reading only.
PLAIN_ABBREVIATIONS: tuple[tuple[str, str, str, str], ...] = (
    ("AAROM", "active assistive range of motion", "active assistive range of motion", "finding"),
    ("BP", "blood pressure", "blood pressure", "vital"),
    ("VS", "vital signs", "vital signs", "vital"),
    ("TPR", "temperature, pulse, respiration", "vital signs", "vital"),
    ("HR", "heart rate", "heart rate", "vital"),
    ("RR", "respiratory rate", "respiratory rate", "vital"),
    ("CBC", "complete blood count", "complete blood count", "lab"),
    ("ABG", "arterial blood gas", "arterial blood gas", "lab"),
    ("UA", "urinalysis", "urinalysis", "lab"),
    ("CXR", "chest X-ray", "chest x-ray", "imaging"),
    ("CT", "computerized tomography", "computed tomography", "imaging"),
    ("MRI", "magnetic resonance imaging", "magnetic resonance imaging", "imaging"),
    ("u/s", "ultrasound", "ultrasound", "imaging"),
    ("HEP", "home exercise program", "home exercise program", "exercise"),
    ("ADL", "activities of daily living", "activities of daily living", "functional-limitation"),
    ("FWB", "full weight bearing", "full weight bearing", "functional-limitation"),
    ("NWB", "non-weight bearing", "non-weight bearing", "functional-limitation"),
    ("WBAT", "weight bearing as tolerated", "weight bearing as tolerated", "functional-limitation"),
    ("RLE", "right lower extremity", "right lower extremity", "body-site"),
    ("LLE", "left lower extremity", "left lower extremity", "body-site"),
    ("RUE", "right upper extremity", "right upper extremity", "body-site"),
    ("LUE", "left upper extremity", "left upper extremity", "body-site"),
    ("MBSS", "modified barium swallow study", "modified barium swallow study", "imaging"),
    ("VFSS", "videofluoroscopic swallowing study", "videofluoroscopic swallowing study", "imaging"),
    ("SLP", "speech-language pathologist", "speech-language pathology", "referral"),
    ("ST", "speech therapy", "speech therapy", "referral"),
    ("AAC", "augmentative and alternative communication", "augmentative and alternative communication", "functional-limitation"),
    ("ASL", "American Sign Language", "American Sign Language", "functional-limitation"),
    ("PMH", "past medical history", "past medical history", "other"),
    ("FH", "family history", "family history", "other"),
    ("SH", "social history", "social history", "other"),
    ("NKA", "no known allergies", "no known allergies", "allergy"),
    ("NPO", "nothing by mouth", "nothing by mouth", "plan"),
    ("SOB", "shortness of breath", "shortness of breath", "symptom"),
    ("DOE", "dyspnea on exertion", "dyspnea on exertion", "symptom"),
    ("CAD", "coronary artery disease", "coronary artery disease", "problem"),
    ("CHF", "congestive heart failure", "congestive heart failure", "problem"),
    ("COPD", "chronic obstructive pulmonary disease", "chronic obstructive pulmonary disease", "problem"),
    ("CVA", "cerebrovascular accident", "cerebrovascular accident", "problem"),
    ("TBI", "traumatic brain injury", "traumatic brain injury", "problem"),
    ("SCI", "spinal cord injury", "spinal cord injury", "problem"),
    ("GERD", "gastroesophageal reflux disease", "gastroesophageal reflux disease", "problem"),
    ("URI", "upper respiratory infection", "upper respiratory infection", "problem"),
    ("UTI", "urinary tract infection", "urinary tract infection", "problem"),
    ("Dx", "diagnosis", "diagnosis", "other"),
    ("Tx", "treatment", "treatment", "plan"),
    ("Rx", "prescription", "prescription", "medication"),
    ("s/p", "status post", "status post", "other"),
    ("f/u", "follow-up", "follow up", "plan"),
    ("c/o", "complains of", "complains of", "other"),
    ("w/o", "without", "without", "other"),
    ("WNL", "within normal limits", "within normal limits", "finding"),
    ("WFL", "within functional limits", "within functional limits", "finding"),
)


def plain_abbreviations() -> list[tuple[str, str, str, str]]:
    return list(PLAIN_ABBREVIATIONS)


def abbreviations_found(notes: DataFrame) -> DataFrame:
    """notes(note_id, text) -> (note_id, abbreviation, meaning, canonical_name, entity_type, mention_count): those of one reading.

    A note's words, runs of letters and digits with slashes inside, are counted once and joined to the table by their lower case;
    no abbreviation is looked for by itself.
    """
    table = fixed(notes.sparkSession, plain_abbreviations(), "abbreviation string, meaning string, canonical_name string, entity_type string")
    known = [a.lower() for a, *_ in plain_abbreviations() if "/" in a]
    slashed = "|".join(known)
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z0-9])(?:{slashed})(?![a-z0-9])|[a-z0-9]+"), F.lit(0))
    rows = notes.select("note_id", F.explode(words).alias("word")).groupBy("note_id", "word").agg(F.count("*").alias("mention_count"))
    found = rows.join(table, F.col("word") == F.lower("abbreviation"))
    return found.select("note_id", "abbreviation", "meaning", "canonical_name", "entity_type", "mention_count")


def first_place(letters: str, text: str) -> Column:
    """Where letters first stand in a text, inside a word or not, by lower case; -1 where they do not occur."""
    return F.call_function("locate", F.lower(letters), F.lower(text)) - 1


def open_abbreviations(notes: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Review entities for abbreviations that stay open: notes(note_id, text), resolutions(note_id, abbreviation, meaning, canonical_name).

    -> (note_id, canonical_name, display_name, entity_type, start_char, end_char, assertion, confidence), at the first place where
    the letters stand, inside a word or not; one that does not occur gives no row.
    """
    rows = resolutions.where("meaning IS NULL AND canonical_name IS NULL").join(merged(notes.select("note_id", "text")), "note_id")
    rows = rows.withColumn("at", first_place("abbreviation", "text")).where("at >= 0")
    return rows.select(
        "note_id", F.concat(F.lit("ambiguous "), "abbreviation").alias("canonical_name"), F.concat(F.lit("Ambiguous "), "abbreviation").alias("display_name"), F.lit("other").alias("entity_type"),
        F.col("at").alias("start_char"), (F.col("at") + F.length("abbreviation")).alias("end_char"), F.lit("possible").alias("assertion"), F.lit("low").alias("confidence"),
    )


def with_disambiguation(entities: DataFrame, resolutions: DataFrame) -> DataFrame:
    """entities(note_id, ord, canonical_name, texts, confidence, ...) gain abbreviation and meaning: the first resolution that fits.

    resolutions(note_id, place, abbreviation, meaning, canonical_name, low): one with a name fits entities of that name, one
    without fits entities with a mention of its letters.  A low one makes the entity's confidence low.
    """
    names = entities.select("note_id", "ord", F.col("canonical_name").alias("key"), F.lit(True).alias("by_name"))
    texts = entities.select("note_id", "ord", F.explode(F.transform("texts", lambda t: F.lower(t))).alias("key"), F.lit(False).alias("by_name"))
    keyed = resolutions.select("note_id", "place", "abbreviation", "meaning", "low", F.coalesce("canonical_name", F.lower("abbreviation")).alias("key"), F.col("canonical_name").isNotNull().alias("by_name"))
    found = names.unionByName(texts).join(merged(keyed), ["note_id", "key", "by_name"]).groupBy("note_id", "ord").agg(F.min(F.struct("place", "abbreviation", "meaning", "low")).alias("_r"))
    out = entities.join(merged(found), ["note_id", "ord"], "left")
    return out.withColumn("confidence", F.when(F.coalesce("_r.low", F.lit(False)), "low").otherwise(F.col("confidence"))).withColumn("abbreviation", F.col("_r.abbreviation")).withColumn("meaning", F.col("_r.meaning")).drop("_r")


def without_nested_symptoms(entities: DataFrame) -> DataFrame:
    """entities(note_id, ord, entity_type, confidence, mentions array<struct<start_char, end_char>>) without the symptoms of which
    every mention lies inside a longer mention of a problem of the same or higher confidence."""
    rank = F.coalesce(*[F.when(F.col("confidence") == word, n) for word, n in CONFIDENCE_RANK.items()])
    spans = entities.select("note_id", "ord", "entity_type", rank.alias("rank"), F.explode("mentions").alias("m")).select("note_id", "ord", "entity_type", "rank", "m.start_char", "m.end_char")
    outer = spans.where("entity_type = 'problem'").select("note_id", F.col("rank").alias("r"), F.col("start_char").alias("a"), F.col("end_char").alias("b"))
    inner = spans.where("entity_type = 'symptom'")
    inside = (inner["note_id"] == outer["note_id"]) & (F.col("a") <= F.col("start_char")) & (F.col("end_char") <= F.col("b")) & (F.col("b") - F.col("a") > F.col("end_char") - F.col("start_char")) & (F.col("r") >= F.col("rank"))
    free = inner.join(merged(outer), inside, "left_anti").select("note_id", "ord").distinct()
    nested = inner.select("note_id", "ord").distinct().join(merged(free), ["note_id", "ord"], "left_anti")
    return entities.join(merged(nested), ["note_id", "ord"], "left_anti")


def imaging_relation(assertion: Column) -> Column:
    return F.when(assertion == "ordered", "ordered-for").otherwise("documents")


def relations(entities: DataFrame, within: int = 180) -> DataFrame:
    """entities(note_id, ord, entity_type, canonical_name, assertion, body_site, start_char, starts, sentences) -> their links:

    (note_id, source, target, relation, confidence), each relation of two entities once.  Links by name (a medication treats, a
    measurement measures, a safety plan supports, imaging of a body site) have high confidence where the two share a
    sentence, else medium; links to the nearest problem that is not absent (imaging, referrals, plans, exercises) have low.
    starts: places of all mentions; sentences: those of the mentions.
    """
    spark = entities.sparkSession
    base = entities.select("note_id", "ord", "entity_type", "canonical_name", "assertion", "sentences")
    by_rule = base.join(relation_rules(spark).withColumnRenamed("source_name", "canonical_name"), "canonical_name")
    by_rule = by_rule.where(F.array_contains("source_types", F.col("entity_type")) | (F.col("relation") == "supports")).select("note_id", "ord", "sentences", "relation", "target_name")
    site = F.coalesce("body_site", "canonical_name")
    target = F.when(F.contains(site, F.lit("lumbar")) | F.contains(site, F.lit("back")), "low back pain").when(F.contains(site, F.lit("shoulder")), "shoulder pain")
    imaging = entities.where("entity_type = 'imaging'").select("note_id", "ord", "sentences", imaging_relation(F.col("assertion")).alias("relation"), target.alias("target_name")).where("target_name IS NOT NULL")
    asked = by_rule.unionByName(imaging).select("note_id", F.col("ord").alias("source"), F.col("sentences").alias("said"), "relation", "target_name")
    first = Window.partitionBy("note_id", "source", "relation", "target_name").orderBy("ord")
    hits = asked.join(merged(base.select("note_id", "ord", "sentences", F.col("canonical_name").alias("target_name"))), ["note_id", "target_name"]).where("ord <> source")
    hits = hits.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    shared = F.coalesce(F.arrays_overlap("said", "sentences"), F.lit(False))
    named = hits.select("note_id", "source", F.col("ord").alias("target"), "relation", F.when(shared, "high").otherwise("medium").alias("confidence"), F.when(shared, 0).otherwise(1).alias("_rank"))
    linked = F.when(F.col("entity_type") == "imaging", imaging_relation(F.col("assertion"))).otherwise("plan-for")
    sources = entities.where(F.col("entity_type").isin("imaging", *PLANNED)).select("note_id", "ord", "start_char", linked.alias("relation"))
    targets = entities.where(F.col("entity_type").isin(*NEAR_TARGETS) & ~F.coalesce(F.col("assertion") == "absent", F.lit(False))).select("note_id", "ord", F.explode("starts").alias("start_char"))
    near = nearest(sources, targets, within).join(merged(sources.select("note_id", F.col("ord").alias("source"), "relation")), ["note_id", "source"])
    near = near.select("note_id", "source", "target", "relation", F.lit("low").alias("confidence"), F.lit(2).alias("_rank"))
    once = Window.partitionBy("note_id", "source", "relation", "target").orderBy("_rank")
    return named.unionByName(near).withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k", "_rank")


# -- the same rules where the entities of a note are one array, so that nothing is joined or shuffled -------------------------
def rules_by_source(spark: SparkSession) -> DataFrame:
    """(source_name, rules): the rules of relation_rules, gathered by the name they start from."""
    return relation_rules(spark).groupBy("source_name").agg(F.collect_list(F.struct("source_types", "relation", "target_name")).alias("rules"))


def problem_spans(entities: Column) -> Column:
    """array<struct<start_char, end_char, rank>>: all mentions of problems among entities(entity_type, rank, spans)."""
    of = lambda e: F.transform(e["spans"], lambda m: F.struct(m["start_char"].alias("start_char"), m["end_char"].alias("end_char"), e["rank"].alias("rank")))
    return F.flatten(F.transform(F.filter(entities, lambda e: e["entity_type"] == "problem"), of))


def is_nested_symptom(e: Column, problems: Column) -> Column:
    """What without_nested_symptoms drops, for an entity(entity_type, rank, spans) and the note's problem_spans."""
    longer = lambda p, m: p["end_char"] - p["start_char"] > m["end_char"] - m["start_char"]
    inside = lambda m: F.exists(problems, lambda p: (p["start_char"] <= m["start_char"]) & (m["end_char"] <= p["end_char"]) & longer(p, m) & (p["rank"] >= e["rank"]))
    return (e["entity_type"] == "symptom") & (F.size(e["spans"]) > 0) & F.forall(e["spans"], lambda m: F.coalesce(inside(m), F.lit(False)))


def fitting_resolution(e: Column, resolutions: Column) -> Column:
    """The resolution of with_disambiguation for an entity(canonical_name, texts); resolutions: array<struct<place, abbreviation,
    meaning, low, canonical_name>>, names in lower case."""
    named = lambda r: r["canonical_name"] == e["canonical_name"]
    said = lambda r: F.exists(e["texts"], lambda t: F.lower(t) == F.lower(r["abbreviation"]))
    return F.array_min(F.filter(resolutions, lambda r: F.when(r["canonical_name"].isNotNull(), named(r)).otherwise(said(r))))


def n_links(e: Column, entities: Column, within: int = 180) -> Column:
    """How many links relations() finds from an entity(ord, entity_type, canonical_name, assertion, first_start, rules) to the other
    entities of its note, which are in order of ord and have spans."""
    link, kind = "array<struct<relation:string,target:int>>", e["entity_type"]
    other = lambda t: t["ord"] != e["ord"]
    of_type = F.filter(e["rules"], lambda r: F.array_contains(r["source_types"], kind) | (r["relation"] == "supports"))
    by_rule = F.transform(of_type, lambda r: F.struct(r["relation"].alias("relation"), r["target_name"].alias("target_name")))
    site = e["canonical_name"]
    pain = F.when(F.contains(site, F.lit("lumbar")) | F.contains(site, F.lit("back")), "low back pain").when(F.contains(site, F.lit("shoulder")), "shoulder pain")
    imaged = F.when(kind == "imaging", F.array(F.struct(imaging_relation(e["assertion"]).alias("relation"), pain.alias("target_name"))))
    none = F.array().cast("array<struct<relation:string,target_name:string>>")
    asked = F.concat(F.coalesce(by_rule, none), F.coalesce(imaged, none))
    first = lambda a: F.try_element_at(F.filter(entities, lambda t: (t["canonical_name"] == a["target_name"]) & other(t)), F.lit(1))["ord"]
    named = F.transform(asked, lambda a: F.struct(a["relation"].alias("relation"), first(a).alias("target"))).cast(link)
    aims = F.filter(entities, lambda t: t["entity_type"].isin(*NEAR_TARGETS) & ~F.coalesce(t["assertion"] == "absent", F.lit(False)) & other(t))
    places = F.flatten(F.transform(aims, lambda t: F.transform(t["spans"], lambda s: F.struct(F.abs(s["start_char"] - e["first_start"]).alias("distance"), t["ord"].alias("target")))))
    closest = F.array_min(F.filter(places, lambda p: p["distance"] <= within))["target"]
    linked = F.when(kind == "imaging", imaging_relation(e["assertion"])).otherwise("plan-for")
    near = F.when(kind.isin("imaging", *PLANNED), F.array(F.struct(linked.alias("relation"), closest.alias("target"))).cast(link)).otherwise(F.array().cast(link))
    return F.size(F.array_distinct(F.filter(F.concat(named, near), lambda x: x["target"].isNotNull())))
