"""The wide vocabulary: pattern families, the dictionary scan with its own negation, laterality, merging and relations."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions.dictionary import DICTIONARY
from chartloom.functions.families import ALL, FAMILIES, Family
from chartloom.functions.spans import containing, let, match_spans
from chartloom.operators.lineage import fixed, merged
from chartloom.operators.sections import sections

FOUND = "array<struct<ord:int,entity_type:string,canonical_name:string,start_char:int,end_char:int,text:string,value:string,unit:string,assertion:string,detail:string>>"


def fits(specialties: Sequence[str], active: Sequence[str]) -> bool:
    """A concept applies when it is for all (mixed) or shares an active specialty."""
    return "mixed" in specialties or bool(set(specialties) & set(active))


def _family_matches(text: Column, f: Family, order: int, lowered: Column) -> Column:
    def one(m: Column) -> Column:
        b = f.build(m)
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(order).alias("ord"), F.lit(f.entity_type).alias("entity_type"), b.get("name", F.lit("family history" if f.name == "family member history" else f.name)).alias("canonical_name"),
            m["start"].alias("start_char"), m["end"].alias("end_char"), m["text"].alias("text"),
            *[F.nullif(b.get(k, null), F.lit("")).alias(k) for k in ("value", "unit", "assertion", "detail")],
        )

    return F.transform(match_spans(text, "(?i)" + f.pattern, f.groups, lowered), one).cast(FOUND)


def family_mentions(notes: DataFrame, active: Sequence[str] = ALL, keep: Sequence[str] = ("note_id",)) -> DataFrame:
    """notes(note_id, text) -> one row a match of any family that fits the active specialties.

    A family's pattern runs only on notes that hold one of the literals it needs; families are columns in groups, so that no
    single expression grows past what the JVM compiles.
    """
    chosen = [(k, f) for k, f in enumerate(FAMILIES) if fits(f.specialties, active)]
    rows, columns = notes.select(*keep, "text", F.lower("text").alias("_low")), []
    for at in range(0, len(chosen), 6):
        group = chosen[at : at + 6]
        columns.append(F.concat(*[_family_matches(F.col("text"), f, k, F.col("_low")) for k, f in group]))
    return rows.select(*keep, F.explode_outer(F.concat(*columns)).alias("m")).where("m IS NOT NULL").select(*keep, "m.*")


# -- dictionary --------------------------------------------------------------------------------------------------------
# Phrases of the dictionary scan's own scoping, and body sites that a side may stand before.
NEGATION = ("denies", "denied", "no", "not", "without", "w/o", "negative for")
NEGATION_CHARS, ORDER_CHARS = 36, 28
PLAN_TYPES = ("plan", "referral", "procedure", "imaging", "exercise")
BODY_SITE = (
    "(?:knee|shoulder|hip|ankle|wrist|elbow|hand|foot|arm|leg|back|flank|eye|ear|breast|chest|calf|thigh|forearm|finger|toe|patella|hamstring|quad|quadricep|rotator cuff|hamstrings|achilles|le|ue|lle|rle|lue|rue)"
)


def segments(text: Column) -> Column:
    """array<struct<start, end, text>>: pieces up to . ! ? or a line end, trimmed, blanks dropped; else the whole text."""
    found = match_spans(text, r"[^.!?\n]+[.!?\n]?")

    def trimmed(m: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(m["text"], r"^\s+", ""), r"\s+$", "")
        start = m["start"] + F.length(m["text"]) - F.length(F.regexp_replace(m["text"], r"^\s+", ""))
        return F.struct(start.alias("start"), (start + F.length(body)).alias("end"), body.alias("text"))

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text")))
    return let(F.filter(F.transform(found, trimmed), lambda s: s["end"] > s["start"]), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(whole))


def laterality(mention: Column, segment: Column) -> Column:
    """bilateral, right or left, only where the word stands before a body site."""
    said = F.lower(F.concat_ws(" ", mention, segment))
    out = None
    for side, words in (("bilateral", "bilateral|bilat"), ("right", "right|r"), ("left", "left|l")):
        here = said.rlike(rf"\b(?:{words})\s+{BODY_SITE}\b")
        out = F.when(here, side) if out is None else out.when(here, side)
    return out


WORD = "[A-Za-z0-9]+"


def _terms(notes: DataFrame, chosen: Sequence[tuple]) -> DataFrame:
    """The terms as a table keyed by their first word, in ASCII lower case: some two hundred rows."""
    rows = []
    for (name, kind, _, _, confidence), term in chosen:
        symbol = any(not (c.isascii() and c.isalnum()) and not c.isspace() for c in term)
        rows.append((re.match(WORD, term)[0].lower(), term.lower(), kind, name, confidence or ("medium" if len(term) <= 3 else "high"), symbol))
    return fixed(notes.sparkSession, rows, "word string, term string, entity_type string, canonical_name string, confidence string, symbol boolean")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered; all other signs, and so the length, stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def dictionary_mentions(notes: DataFrame, concepts: Sequence[tuple] = DICTIONARY, active: Sequence[str] = ALL, keep: Sequence[str] = ("note_id",)) -> DataFrame:
    """notes(note_id, text) -> one row a term found: canonical_name, entity_type, text, span, assertion, temporality, side.

    A note's words are found once; those that begin a term, and only those, become rows and are joined to the terms; where the
    whole term stands there, not inside a word, it is a mention.  So terms inside longer terms are found too, and the cost does
    not grow with the dictionary.
    Scoping is this scan's own: a negation in the 36 characters before the mention in its segment, an order verb in the 28,
    then what the section says.
    """
    chosen = [(c, t) for c in concepts if fits(c[3], active) for t in c[2]]
    first = sorted({re.match(WORD, t)[0].lower() for _, t in chosen})
    begins = F.filter(F.transform(match_spans(F.col("text"), WORD), lambda w: F.struct(w["start"].alias("start"), ascii_lower(w["text"]).alias("word"))), lambda w: w["word"].isin(*first))
    words = notes.select(*keep, "text", F.explode(begins).alias("w")).select(*keep, "text", F.col("w.start").alias("start_char"), "w.word")
    found = words.join(_terms(notes, chosen), "word").withColumn("end_char", F.col("start_char") + F.length("term"))
    here = F.substr("text", F.col("start_char") + 1, F.length("term"))
    after = F.substr("text", F.col("end_char") + 1, F.lit(1))
    inside = F.when(F.col("symbol"), after.rlike("^[A-Za-z0-9]")).otherwise(after.rlike("^[-A-Za-z0-9]"))
    found = found.where((ascii_lower(here) == F.col("term")) & ~inside)
    m = F.struct("entity_type", "canonical_name", "start_char", "end_char", here.alias("text"), "confidence").alias("m")
    rows = found.select(*keep, segments(F.col("text")).alias("segs"), sections(F.col("text")).alias("secs"), m)
    seg = containing(F.col("segs"), F.col("m.start_char"))
    rows = rows.select(*keep, "secs", "m.*", seg.alias("seg"))
    inside = lambda a, b: F.filter("secs", lambda s: (s["start"] <= a) & (a < s["end"]) if b is None else (s["start"] >= a) & (s["start"] < b))
    section = F.coalesce(F.try_element_at(inside(F.col("seg.start"), None), F.lit(1)), F.try_element_at(inside(F.col("seg.start"), F.col("seg.end")), F.lit(1)), F.try_element_at("secs", F.lit(1)))["name"]
    rows = rows.withColumn("section", section).withColumn("lead", F.col("start_char") - F.col("seg.start"))
    near = lambda n: F.expr(f"substring(seg.text, greatest(0, lead - {n}) + 1, least(lead, {n}))")
    words = "|".join("".join("\\" + c if c in "/" else c for c in w) for w in NEGATION)
    negated = near(NEGATION_CHARS).rlike(rf"(?i)(?:^|\W)(?:{words})(?:$|\W)")
    ordered = near(ORDER_CHARS).rlike(r"(?i)\b(ordered|order|obtain|check)\b")
    planned = F.col("section").isin("plan", "assessment-plan") & F.col("entity_type").isin(*PLAN_TYPES)
    assertion = F.when(negated, "absent").when(ordered, "ordered").when(F.col("section") == "family-history", "family-history").when(planned, "planned").otherwise("present")
    rows = rows.withColumn("assertion", assertion).withColumn("temporality", F.when(F.col("section") == "past-medical-history", "past")).withColumn("laterality", laterality(F.col("text"), F.col("seg.text")))
    return rows.select(*keep, "entity_type", "canonical_name", "text", "start_char", "end_char", "confidence", "section", "assertion", "temporality", "laterality", F.col("seg.text").alias("sentence"))


def merged_entities(mentions: DataFrame, sides: Sequence[Column] = ()) -> DataFrame:
    """Entities of a note by (type, name in lower case): mentions ordered by start, longest first, overlapping ones dropped.

    Assertions that differ make the entity conflicting; an undefined one gives way to any other.
    sides: further aggregates of an entity's mentions, by name.
    """
    keys = ("note_id", "entity_type", "canonical_name")
    rows = mentions.withColumn("canonical_name", F.lower("canonical_name"))
    one = F.struct("start_char", (-F.col("end_char")).alias("back"), "text")
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"), F.array_sort(F.collect_set("assertion")).alias("kinds"), *sides)
    more = [c for c in grouped.columns if c not in (*keys, "all", "kinds")]
    state = "struct<end:int, kept:array<struct<start_char:int,back:int,text:string>>>"
    first = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start_char:int,back:int,text:string>>").alias("kept")).cast(state)
    step = lambda a, m: F.when(m["start_char"] < a["end"], a).otherwise(F.struct((-m["back"]).alias("end"), F.concat(a["kept"], F.array(m)).alias("kept")).cast(state))
    kept = F.aggregate(F.col("all").cast("array<struct<start_char:int,back:int,text:string>>"), first, step)["kept"]
    assertion = F.when(F.size("kinds") > 1, "conflicting").otherwise(F.try_element_at("kinds", F.lit(1)))
    out = grouped.select(*keys, assertion.alias("assertion"), kept.alias("mentions"), *more)
    return out.select(*keys, "assertion", F.size("mentions").alias("mention_count"), F.col("mentions")[0]["start_char"].alias("first_start"), F.col("mentions")[0]["text"].alias("first_text"), *more)


def nearest(sources: DataFrame, targets: DataFrame, within: int = 180) -> DataFrame:
    """For each source the target of the same note whose start is closest, within a distance; ties to the earlier ord.

    Both: (note_id, ord, start_char).  One row a source that has any.
    """
    s = sources.select("note_id", F.col("ord").alias("source"), F.col("start_char").alias("s_start"))
    t = targets.select("note_id", F.col("ord").alias("target"), F.col("start_char").alias("t_start"))
    pairs = s.join(merged(t), "note_id").where("source <> target").withColumn("distance", F.abs(F.col("s_start") - F.col("t_start"))).where(F.col("distance") <= within)
    w = Window.partitionBy("note_id", "source").orderBy("distance", "target")
    return pairs.withColumn("k", F.row_number().over(w)).where("k = 1").select("note_id", "source", "target", "distance")
