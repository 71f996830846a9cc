"""From notes to mentions: concept scan, ambiguous-SI guard, dedupe, assertion scoping, triage and hybrid merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import lexicon as L
from chartloom.functions.spans import any_of, containing, let, match_spans, overlap, sentence_spans
from chartloom.operators.assertion import AssertionRules, resolve

MENTION_COLUMNS = ("entity_type", "text", "normalized_text", "start_char", "end_char", "assertion", "confidence_score", "section_context", "attributes")
MENTION = "struct<start_char int, end_char int, text string, entity_type string, normalized_text string, section_context string, confidence_score double, attributes map<string,string>, concept_ord int>"


def _concept_mentions(text: Column, concept: L.Concept, order: int) -> Column:
    fixed = [x for k, v in concept.attributes.items() if k not in concept.groups for x in (F.lit(k), F.lit(v))]

    def mention(m: Column) -> Column:
        pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(g).alias("key"), m[f"g{k}"].alias("value")) for k, g in enumerate(concept.groups, 1)]), lambda e: e["value"].isNotNull())) if concept.groups else None
        attributes = F.create_map(*fixed) if fixed else F.create_map().cast("map<string,string>")
        attributes = F.map_concat(attributes, pairs) if pairs is not None else attributes
        return F.struct(
            m["start"].alias("start_char"),
            m["end"].alias("end_char"),
            m["text"].alias("text"),
            F.lit(concept.entity_type).alias("entity_type"),
            F.lit(concept.normalized_text).alias("normalized_text"),
            F.lit(concept.section).cast("string").alias("section_context"),
            F.lit(concept.confidence).alias("confidence_score"),
            attributes.alias("attributes"),
            F.lit(order).alias("concept_ord"),
        ).cast(MENTION)

    return F.transform(match_spans(text, concept.pattern, len(concept.groups)), mention)


def guarded_si(m: Column, cue: Column) -> Column:
    """A bare SI in a note without a psychiatric cue keeps its place with low confidence and a reason for review."""
    noted = F.map_concat(m["attributes"], F.create_map(F.lit("review_reason"), F.lit("ambiguous-SI-no-psych-context")))
    low = m.withField("confidence_score", F.least(m["confidence_score"], F.lit(L.SI_CONFIDENCE))).withField("attributes", noted)
    bare = (m["normalized_text"] == "suicidal ideation") & (F.upper(F.trim(m["text"])) == "SI") & ~F.coalesce(cue, F.lit(False))
    return F.when(bare, low).otherwise(m)


def extract_mentions(notes: DataFrame, concepts: Sequence[L.Concept] = L.CONCEPTS, rules: AssertionRules = AssertionRules(), keep: Sequence[str] = ("note_id",)) -> DataFrame:
    """notes(note_id, text, ...) -> one row a mention, assertions resolved.

    Columns: `keep`, mention_idx (in offset order), text, entity_type, normalized_text, start_char, end_char, assertion,
    decision, trigger, sentence, confidence_score, section_context, attributes.  The whole operator is one projection and
    one explode: sentences are found once a note, and only the mention's sentence travels on.
    """
    text = F.col("text")
    found = F.concat(*[_concept_mentions(text, c, k) for k, c in enumerate(concepts or L.CONCEPTS)])
    # of equal (type, span), the first in concept order stays
    kept = let(found, lambda f: let(_in_order(f), _first_of_equals))
    guarded = let(text.rlike(L.PSYCH_CONTEXT), lambda cue: F.transform(kept, lambda m: guarded_si(m, cue)))
    rows = notes.select(*keep, guarded.alias("found"), sentence_spans(text).alias("sentences"))
    # the outer form: for the inner one, Catalyst would find all mentions a second time to drop notes without any
    rows = rows.select(*keep, "sentences", F.posexplode_outer("found").alias("mention_idx", "m")).where("m IS NOT NULL")
    s = containing(F.col("sentences"), F.col("m.start_char"))
    rows = rows.select(*keep, "mention_idx", "m.*", s.alias("s"))
    before = F.expr("substring(s.text, 1, start_char - s.start)")
    after = F.expr("substring(s.text, end_char - s.start + 1)")
    rows = rows.select(*keep, "mention_idx", *[f for f in ("text", "entity_type", "normalized_text", "start_char", "end_char", "confidence_score", "section_context", "attributes")], F.col("s.text").alias("sentence"), before.alias("before"), after.alias("after"))
    return resolve(rows, rules).drop("before", "after")


def _in_order(mentions: Column) -> Column:
    """By start, end and type; of equals, in concept order."""
    keys = F.transform(mentions, lambda m, i: F.struct(m["start_char"].alias("a"), m["end_char"].alias("b"), m["entity_type"].alias("t"), m["concept_ord"].alias("o"), i.alias("i")))
    return F.transform(F.sort_array(keys), lambda k: mentions[k["i"]])


def _first_of_equals(mentions: Column) -> Column:
    def same(a: Column, b: Column) -> Column:
        return (a["start_char"] == b["start_char"]) & (a["end_char"] == b["end_char"]) & (a["entity_type"] == b["entity_type"])

    return F.filter(mentions, lambda m, i: (i == 0) | ~F.coalesce(same(m, F.try_element_at(mentions, F.when(i > 0, i).otherwise(1))), F.lit(False)))


def dedupe_mentions(mentions: DataFrame, keys: Sequence[str] = ("note_id",), order: Sequence[str] = ()) -> DataFrame:
    """Of mentions with equal type and span, one row: the first by `order`."""
    w = Window.partitionBy(*keys, "entity_type", "start_char", "end_char").orderBy(*(order or ("text",)))
    return mentions.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def triage(notes: DataFrame, mentions: DataFrame, max_chars: int = 2400, skip_from: float = 0.75) -> DataFrame:
    """(note_id, requires_llm, reasons, compressed_text): which notes a language model should see, and the excerpt for it."""
    of_note = mentions.groupBy("note_id").agg(F.min("confidence_score").alias("least"), F.collect_list("start_char").alias("starts"))
    rows = notes.select("note_id", "text").join(of_note, "note_id", "left")
    ambiguous = F.col("text").rlike(any_of(L.AMBIGUOUS))
    reasons = F.array_compact(
        F.array(
            F.when(ambiguous, F.lit("ambiguous_or_reasoning_context")),
            F.when(F.col("least") < skip_from, F.lit("low_confidence_nlp")),
            F.when(F.col("least").isNull() & (F.trim("text") != ""), F.lit("no_deterministic_mentions")),
        )
    )
    rows = rows.withColumn("reasons", reasons).withColumn("requires_llm", F.size("reasons") > 0)
    return rows.select("note_id", "requires_llm", "reasons", F.when(F.col("requires_llm"), compressed(F.col("text"), F.coalesce("starts", F.array().cast("array<int>")), max_chars)).otherwise("").alias("compressed_text"))


def compressed(text: Column, starts: Column, max_chars: int) -> Column:
    """Sentences that hold a mention or call for reasoning, each once, a line each, within the budget; else the note."""
    chosen = F.filter(sentence_spans(text), lambda s: F.exists(starts, lambda x: (s["start"] <= x) & (x < s["end"])) | s["text"].rlike(any_of(L.AMBIGUOUS)))
    lines = F.array_join(F.array_distinct(F.transform(chosen, lambda s: s["text"])), "\n")
    body = F.when(lines == "", F.trim(text)).otherwise(lines)
    cut = F.concat(F.regexp_replace(F.substring(body, 1, max_chars - 24), r"\s+$", ""), F.lit("\n[truncated for budget]"))
    return F.when(F.length(body) <= max_chars, body).otherwise(cut)


def remap_to_source(found: DataFrame) -> DataFrame:
    """Rows (note_id, text, compressed_text, m_text, m_start, m_end, ...) with offsets in the excerpt -> offsets in the note.

    Each excerpt line is looked up after the end of the line before it, else from the start; a mention outside every
    found line, or whose text does not come back at its new place, is dropped.
    """
    lines = F.split("compressed_text", "\n", -1)
    state = "struct<at: int, from: int, lines: array<struct<start: int, end: int, found: int>>>"
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.array().cast("array<struct<start:int,end:int,found:int>>").alias("lines")).cast(state)

    def step(a: Column, line: Column) -> Column:
        ahead = F.call_function("locate", line, F.col("text"), a["from"] + 1)
        hit = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", line, F.col("text"))) - 1
        kept = (hit >= 0) & (line != "")
        one = F.struct(a["at"].alias("start"), (a["at"] + F.length(line)).alias("end"), hit.alias("found"))
        return F.struct((a["at"] + F.length(line) + 1).alias("at"), F.when(kept, hit + F.length(line)).otherwise(a["from"]).alias("from"), F.when(kept, F.concat(a["lines"], F.array(one))).otherwise(a["lines"]).alias("lines")).cast(state)

    mapped = F.aggregate(lines, first, step)["lines"]
    target = F.try_element_at(F.filter(mapped, lambda e: (e["start"] <= F.col("m_start")) & (F.col("m_end") <= e["end"])), F.lit(1))
    rows = found.withColumn("_target", target).where(F.col("_target").isNotNull())
    rows = rows.withColumn("start_char", F.col("m_start") + F.col("_target.found") - F.col("_target.start")).withColumn("end_char", F.col("m_end") + F.col("_target.found") - F.col("_target.start"))
    return rows.where(F.expr("substring(text, start_char + 1, end_char - start_char) = m_text")).drop("_target")


def merge_mentions(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """All primary mentions, and the secondary ones that no kept mention of the same type and name overlaps, in order.

    Both: (note_id, idx, entity_type, canonical_text, start_char, end_char).  A secondary mention also yields to an earlier
    kept secondary one, so each note's mentions of one name are folded in order; the fold's input is one name in one note.
    """
    keys = ("note_id", "entity_type", "canonical_text")
    both = primary.select(*keys, "start_char", "end_char", "idx", F.lit(0).alias("side")).unionByName(secondary.select(*keys, "start_char", "end_char", "idx", F.lit(1).alias("side")))
    grouped = both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("side", "idx", "start_char", "end_char"))).alias("all"))
    kind = "array<struct<side:int,idx:int,start_char:int,end_char:int>>"

    def step(kept: Column, m: Column) -> Column:
        clash = (m["side"] == 1) & F.exists(kept, lambda k: overlap(k["start_char"], k["end_char"], m["start_char"], m["end_char"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(m)))

    kept = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), step)
    return grouped.select(*keys, F.explode(kept).alias("m")).select(*keys, "m.*")
