"""The wide extraction as one operator: dictionary, families and open abbreviations, merged, coded, linked and ranked for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.spans import let
from chartloom.operators import relations as N
from chartloom.operators import terminology as T
from chartloom.operators import vocabulary as W
from chartloom.operators.context import MX, PC, note_abbreviations
from chartloom.operators.documents import uncertainty
from chartloom.operators.relations import CONFIDENCE_RANK

# Words that are written in capitals.
ACRONYMS = (
    "A1C", "AROM", "AVH", "BMI", "BP", "CBC", "CP", "CT", "CXR", "ER", "FHX", "GAD", "GAD-7", "HB", "HDL", "HEP", "HGB", "HR", "IR", "LDL", "MRI", "MMT", "PHQ-9", "PROM", "PT", "RR", "SI", "SOB", "SPO2", "TG",
    "TSH", "US", "WBC",
)


def display_case(c: Column) -> Column:
    """Words with a raised first letter and the rest lowered, acronyms in capitals; white space and hyphens stay."""
    parts = F.regexp_extract_all(c, F.lit(r"[^\s-]+|[\s-]+"), F.lit(0))
    word = lambda p: F.when(F.upper(p).isin(*ACRONYMS), F.upper(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 100_000))))
    return F.array_join(F.transform(parts, word), "")


def extraction_specialties(specialty: Column, mode: Column, active: Column) -> Column:
    """The specialties to extract for: all where mixed is chosen, the chosen one, or those that the note speaks of (mode auto)."""
    chosen = ~F.coalesce(mode == "auto", F.lit(False)) & specialty.isNotNull()
    every = F.array(*[F.lit(s) for s in (PC, "mental-health", "physical-therapy", MX)])
    return F.when(chosen & (specialty == MX), every).when(chosen, F.array(specialty)).otherwise(active)


def merged_attributes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, ord, attributes, confidence, explanation) -> one row a key: of each attribute the last value by ord, the highest
    confidence, and the explanations once each, in order."""
    rank = F.coalesce(*[F.when(F.col("confidence") == word, n) for word, n in CONFIDENCE_RANK.items()])
    none = F.array().cast("array<struct<key:string,value:string>>")
    listed = rows.withColumn("_entries", F.coalesce(F.map_entries("attributes"), none))
    grouped = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("_entries").alias("a"), "explanation"))).alias("all"), F.max(rank).alias("rank"))
    entries = F.flatten(F.transform("all", lambda x: x["a"]))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    words = F.array_distinct(F.filter(F.transform("all", lambda x: x["explanation"]), lambda s: s.isNotNull() & (s != "")))
    confidence = F.coalesce(*[F.when(F.col("rank") == n, word) for word, n in CONFIDENCE_RANK.items()])
    return grouped.select(*keys, F.map_from_entries(last).alias("attributes"), confidence.alias("confidence"), F.array_join(words, " ").alias("explanation"))


_RESOLUTION = "struct<place:int,abbreviation:string,meaning:string,low:boolean,canonical_name:string>"


def _abbreviations(notes: DataFrame) -> DataFrame:
    """A row an ambiguous abbreviation of a note: its resolution, and beside it the mention where it stays open and occurs.

    Where it is resolved, the mention's columns are null.
    """
    rows = note_abbreviations(notes, ("note_id", "text")).withColumnRenamed("text", "note").withColumn("at", N.first_place("abbreviation", "note"))
    here = lambda c: F.when(F.col("meaning").isNull() & F.col("canonical_name").isNull() & (F.col("at") >= 0), c)
    none = F.lit(None).cast("string")
    return rows.select(
        "note_id", here(F.lit("other")).alias("entity_type"), here(F.concat(F.lit("ambiguous "), "abbreviation")).alias("canonical_name"), here(F.lit("possible")).alias("assertion"), here(F.lit("low")).alias("confidence"),
        here(F.col("abbreviation")).alias("text"), here(F.col("at")).alias("start_char"), here(F.col("at") + F.length("abbreviation")).alias("end_char"), none.alias("section"), none.alias("sentence"),
        F.struct("place", "abbreviation", "meaning", F.col("meaning").isNull().alias("low"), F.lower("canonical_name").alias("canonical_name")).cast(_RESOLUTION).alias("resolution"),
    )


def _linked(entities: Column, resolutions: Column) -> Column:
    """A note's entities, in order, without nested symptoms, with the resolution that fits each and the number of its links."""
    words = lambda rank: F.coalesce(*[F.when(rank == n, word) for word, n in CONFIDENCE_RANK.items()])
    placed = F.transform(entities, lambda e, i: e.withField("ord", i + 1))

    def linked(kept: Column) -> Column:
        def one(e: Column) -> Column:
            def told(r: Column) -> Column:
                confidence = F.when(F.coalesce(r["low"], F.lit(False)), "low").otherwise(words(e["rank"]))
                plain = [e[c].alias(c) for c in ("ord", "entity_type", "canonical_name", "assertion", "mention_count", "first_start", "texts", "sections")]
                return F.struct(*plain, confidence.alias("confidence"), r["abbreviation"].alias("abbreviation"), r["meaning"].alias("meaning"), N.n_links(e, kept).cast("bigint").alias("n_relations"))

            return let(N.fitting_resolution(e, resolutions), told)

        return F.transform(kept, one)

    free = let(N.problem_spans(entities), lambda problems: F.filter(placed, lambda e: ~N.is_nested_symptom(e, problems)))
    return let(free, linked)


def documents(notes: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """notes(note_id, text) -> one row an entity:

    (note_id, ord, entity_type, canonical_name, assertion, confidence, mention_count, first_start, codings, abbreviation, meaning,
    n_relations, priority, uncertainty_reasons).  Blank notes give none.
    """
    notes = notes.select("note_id", "text").where(F.trim("text") != "")
    codes = codes if codes is not None else T.built_in_seed(notes.sparkSession)
    # notes dealt by their key are grouped where they are: no table is written, and none but the notes is shuffled
    keys = ("note_id", "entity_type", "canonical_name", "assertion", "confidence", "text", "start_char", "end_char", "section", "sentence")
    none, unresolved = F.lit(None).cast("string"), F.lit(None).cast(_RESOLUTION).alias("resolution")
    scanned = W.dictionary_mentions(notes).select(*keys, unresolved)
    family = W.family_mentions(notes).select("note_id", "entity_type", "canonical_name", "assertion", F.lit("high").alias("confidence"), "text", "start_char", "end_char", none.alias("section"), none.alias("sentence"), unresolved)
    mentions = scanned.unionByName(family).unionByName(_abbreviations(notes).select(*keys, "resolution"))
    rank = F.coalesce(*[F.when(F.col("confidence") == word, n) for word, n in CONFIDENCE_RANK.items()])
    sides = [
        F.max(rank).alias("rank"), F.array_distinct(F.collect_list("text")).alias("texts"), F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("spans"),
        F.array_distinct(F.collect_list("sentence")).alias("sentences"), F.array_distinct(F.collect_list(F.coalesce("section", F.lit("unknown")))).alias("sections"), F.collect_list("resolution").alias("resolutions"),
    ]
    found = W.merged_entities(mentions, sides)
    found = found.join(N.rules_by_source(notes.sparkSession), F.col("canonical_name") == F.col("source_name"), "left")
    one = F.struct("first_start", "entity_type", "canonical_name", "assertion", "rank", "mention_count", "texts", "spans", "sections", "rules")
    whole = found.groupBy("note_id").agg(F.array_sort(F.collect_list(F.when(F.col("canonical_name").isNotNull(), one))).alias("_all"), F.flatten(F.collect_list("resolutions")).alias("_resolutions"))
    # the outer form: for the inner one, Catalyst would make all entities a second time, to drop notes without any
    entities = whole.select("note_id", F.explode_outer(_linked(F.col("_all"), F.col("_resolutions"))).alias("e")).where("e IS NOT NULL").select("note_id", "e.*")
    entities = T.with_codings(entities, codes, F.col("canonical_name"))
    entities = entities.withColumn("n_codings", F.size("codings")).withColumn("low_coding", F.exists("codings", lambda c: c["confidence"] < 0.5))
    ranked = uncertainty(entities)
    return ranked.select("note_id", "ord", "entity_type", "canonical_name", "assertion", "confidence", "mention_count", "first_start", "codings", "abbreviation", "meaning", "n_relations", "priority", "uncertainty_reasons")
