"""The cascade: rules first, a language model for what the rules leave open, and one list of mentions from both."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.operators import rollup as R
from chartloom.operators import sessions as S
from chartloom.operators.adapters import LLM_MENTION, implausible
from chartloom.operators.extraction import MENTION_COLUMNS, extract_mentions, merge_mentions, remap_to_source, triage
from chartloom.operators.ledger import Client, Ledger, prompt_key
from chartloom.operators.lineage import cut_lineage
from chartloom.operators.sessions import ASSERTIONS, ENTITY_TYPES

MODES = ("nlp", "llm", "hybrid")
SYSTEM_PROMPT = "List what this clinical note states, as JSON of the form below and nothing else. Count offsets in characters from 0, the end exclusive. What the note denies is absent; what it leaves open is possible."
FORM = (
    '{"mentions": [{"text": "words of the note", "entity_type": "one of: ' + ", ".join(ENTITY_TYPES) + '", "start_char": 0, "end_char": 1, "assertion": "one of: ' + ", ".join(ASSERTIONS) + '", '
    '"confidence_score": 1.0, "normalized_text": "usual name", "attributes": {"name": "plain value"}}]}'
)
_TEXTS = ("section_context", "resolved_abbreviation", "source_id", "mention_id", "normalized_text")
_FIELDS = ("text", "entity_type", "start_char", "end_char", "assertion", "confidence_score", "attributes", *_TEXTS)
_WHOLE = r"^\s*[+-]?\d+\s*$"


def messages(text: Column, correction: Column | None = None) -> Column:
    """The prompt for a note as array<struct<role, content>>: instructions, the form with what was wrong with the last answer, the note."""
    more = F.coalesce(F.concat(F.lit("\nYour last answer was refused: "), correction), F.lit("")) if correction is not None else F.lit("")
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(one("system", F.concat(F.lit(SYSTEM_PROMPT), more)), one("system", F.lit(f"Form:\n{FORM}")), one("user", F.concat(F.lit("Note:\n"), text)))


def _whole_number(v: Column, path: str) -> Column:
    """The whole number at a path, also one in quotes; null for anything else."""
    number, quoted = F.try_variant_get(v, path, "double"), S._text(v, path)
    return F.when(S._number(v, path) & (number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int")).when(quoted.rlike(_WHOLE), F.trim(quoted).try_cast("int"))


def _parsed(v: Column) -> Column:
    """The parts of a mention as written, each read once; _problem tells which of them can't stand."""
    texts = [F.coalesce(S._kind(v, f"$.{k}").isin("VOID", "STRING"), F.lit(True)).alias(k) for k in _TEXTS]
    return F.struct(
        S._is(v, "$", "OBJECT").alias("whole"),
        F.map_keys(F.try_variant_get(v, "$", "map<string, variant>")).alias("names"),
        F.trim(S._text(v, "$.text")).alias("text"),
        S._text(v, "$.entity_type").alias("entity_type"),
        _whole_number(v, "$.start_char").alias("start_char"),
        _whole_number(v, "$.end_char").alias("end_char"),
        F.when(S._kind(v, "$.assertion").isNull(), "present").otherwise(S._text(v, "$.assertion")).alias("assertion"),
        F.when(S._kind(v, "$.confidence_score").isNull(), F.lit(1.0)).otherwise(F.try_variant_get(v, "$.confidence_score", "double")).alias("confidence_score"),
        F.trim(S._text(v, "$.normalized_text")).alias("normalized_text"),
        F.struct(*texts).alias("texts"),
        S._kind(v, "$.attributes").alias("attributes_kind"),
        F.transform_values(F.try_variant_get(v, "$.attributes", "map<string, variant>"), lambda k, x: F.struct(F.schema_of_variant(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("value"))).alias("given"),
    )


def _mention(p: Column) -> Column:
    """A parsed mention as LLM_MENTION."""
    attributes = F.coalesce(F.transform_values(F.map_filter(p["given"], lambda k, x: x["value"].isNotNull()), lambda k, x: x["value"]), F.create_map().cast("map<string,string>"))
    return F.struct(*[p[c].alias(c) for c in ("text", "entity_type", "start_char", "end_char", "assertion", "confidence_score", "normalized_text")], attributes.alias("attributes"))


def _problem(p: Column, m: Column) -> Column:
    """Why a mention, parsed and as a record, can't stand, without its words; null where it can."""
    no = lambda ok, what: F.when(~F.coalesce(ok, F.lit(False)), what)
    flat = F.forall(F.map_entries(p["given"]), lambda e: (F.trim(e["key"]) != "") & ~F.coalesce(e["value"]["kind"].rlike("^(ARRAY|OBJECT)"), F.lit(False)))
    return F.when(~p["whole"], "a mention must be an object").otherwise(
        F.coalesce(
            no(F.forall(p["names"], lambda n: n.isin(*_FIELDS)), "there are fields that the form does not have"),
            no(p["text"] != "", "text is missing or blank"),
            no(p["entity_type"].isin(*ENTITY_TYPES), "entity_type is unknown"),
            no(p["start_char"] >= 0, "start_char is no whole number from 0 on"),
            no(p["end_char"] > p["start_char"], "end_char is not behind start_char"),
            no(p["assertion"].isin(*ASSERTIONS), "assertion is unknown"),
            no(p["confidence_score"].between(0, 1), "confidence_score is not from 0 to 1"),
            *[no(p["texts"][k], f"{k} is no text") for k in _TEXTS],
            no(p["attributes_kind"].isNull() | (p["attributes_kind"].startswith("OBJECT") & flat), "attributes are no object of plain values"),
            implausible(m),
        )
    )


def judged(answers: DataFrame) -> DataFrame:
    """answers(answer, ...) -> the same with mentions array<LLM_MENTION> and error, one of which is null, in place of answer.

    An answer is JSON: an array of mentions, or an object whose only field is such an array.  The error names each bad
    mention by place, type (if it is one) and span, never by words of the note.
    """
    rows = answers.withColumn("_v", F.try_parse_json("answer"))
    v = F.col("_v")
    only = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string, variant>")) == F.array(F.lit("mentions")), F.lit(False))
    rows = rows.withColumn("_items", F.when(S._is(v, "$", "ARRAY"), S._items(v, "$")).when(only, S._items(v, "$.mentions")))
    rows = rows.withColumn("_parsed", F.transform("_items", _parsed)).withColumn("mentions", F.transform("_parsed", _mention).cast(f"array<{LLM_MENTION}>"))
    rows = rows.withColumn("_problems", F.zip_with("_parsed", "mentions", _problem))

    def told(x: Column, i: Column) -> Column:
        m = F.get("_parsed", i)
        kind = F.coalesce(F.when(m["entity_type"].isin(*ENTITY_TYPES), m["entity_type"]), F.lit("unknown"))
        place = [F.coalesce(m[k].cast("string"), F.lit("?")) for k in ("start_char", "end_char")]
        return F.when(x.isNotNull(), F.concat(F.lit("mention["), i.cast("string"), F.lit("] type="), kind, F.lit(" span=("), place[0], F.lit(", "), place[1], F.lit("): "), x))

    rows = rows.withColumn("_told", F.array_join(F.array_compact(F.transform("_problems", told)), "; "))
    error = F.when(F.col("answer").isNull(), "there was no answer").when(v.isNull(), "the answer is not JSON").when(F.col("_items").isNull(), "the answer holds no list of mentions").when(F.col("_told") != "", F.col("_told"))
    rows = rows.withColumn("error", error).withColumn("mentions", F.when(F.col("error").isNull(), F.col("mentions")))
    return rows.drop("answer", "_v", "_items", "_parsed", "_problems", "_told")


def model_answers(notes: DataFrame, make_client: Callable[[], Client], retries: int = 2, max_chars: int = 8000, ledger: Ledger | None = None, model: str = "") -> DataFrame:
    """notes(note_id, text) -> (note_id, mentions, attempts, error): up to retries + 1 tries, each told what was wrong with the last.

    A try is a round over all notes that are still open: their prompts go through the ledger, so that equal prompts, and
    those of a run that broke off, are asked once.  The client gets the messages of the prompt and gives JSON.  A note whose
    tries all fail has null mentions and the last error.  Null texts are empty.
    """
    ledger = ledger or Ledger(notes.sparkSession)
    open_ = notes.select("note_id", F.substring(F.coalesce("text", F.lit("")), 1, max_chars).alias("text"), F.lit(None).cast("string").alias("error"))
    ended = []
    for attempt in range(1, retries + 2):
        prompts = open_.withColumn("messages", messages(F.col("text"), F.col("error"))).withColumn("key", prompt_key(F.col("messages"), model)).drop("error")
        answers = ledger.ask(prompts.select("key", "messages"), make_client)
        round_ = cut_lineage(prompts.drop("messages").join(judged(answers), "key").select("note_id", "text", "mentions", F.lit(attempt).alias("attempts"), "error"))
        last = attempt == retries + 1
        ended.append((round_ if last else round_.where("error IS NULL")).drop("text"))
        open_ = round_.where("error IS NOT NULL").select("note_id", "text", "error")
        if last or open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended)


def _as_mentions(answers: DataFrame) -> DataFrame:
    rows = answers.select("note_id", F.posexplode_outer("mentions").alias("idx", "m")).where("m IS NOT NULL")
    return rows.select("note_id", F.col("idx").cast("int").alias("idx"), "m.*")


def hybrid(notes: DataFrame, make_client: Callable[[], Client], max_chars: int = 2400, retries: int = 2, ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions, outcomes) of notes(note_id, text).

    Rules run on every note.  Notes that triage sends on are shown to the model as an excerpt; what it finds is moved back
    to the note's offsets and merged, rules first.  The rules' mentions and the routes are written once, since each round of the
    model and the merge read them again.  outcomes(note_id, escalated, escalation_failed): a note whose model
    answers all fail keeps the rules' mentions and is marked.
    """
    own = cut_lineage(extract_mentions(notes).select("note_id", "mention_idx", *MENTION_COLUMNS))
    routed = cut_lineage(triage(notes, own, max_chars))
    asked = routed.where("requires_llm").select("note_id", F.col("compressed_text").alias("text"))
    answers = model_answers(asked, make_client, retries, ledger=ledger)
    found = _as_mentions(answers.where("mentions IS NOT NULL")).withColumnsRenamed({"text": "m_text", "start_char": "m_start", "end_char": "m_end"})
    moved = remap_to_source(found.join(notes.select("note_id", "text"), "note_id").join(routed.select("note_id", "compressed_text"), "note_id"))
    second = moved.select("note_id", "idx", "entity_type", F.col("m_text").alias("text"), "normalized_text", "start_char", "end_char", "assertion", "confidence_score", F.lit(None).cast("string").alias("section_context"), "attributes")
    first = own.withColumn("idx", F.col("mention_idx").cast("int"))
    sides = {0: first.withColumn("canonical_text", R.canonical()), 1: second.withColumn("canonical_text", R.canonical())}
    kept = merge_mentions(sides[0], sides[1])
    details = [side.select("note_id", F.lit(k).alias("side"), "idx", *MENTION_COLUMNS) for k, side in sides.items()]
    merged = kept.select("note_id", "side", "idx").join(details[0].unionByName(details[1]), ["note_id", "side", "idx"])
    failed = answers.select("note_id", F.lit(True).alias("escalated"), F.col("mentions").isNull().alias("escalation_failed"))
    outcomes = notes.select("note_id").join(failed, "note_id", "left").select("note_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("escalated", "escalation_failed")])
    return merged, outcomes


def extractor(mode: str = "nlp", make_client: Callable[[], Client] | None = None, retries: int = 2, max_chars: int = 2400) -> Callable[[DataFrame], DataFrame]:
    """A function from notes to mentions, by mode; llm and hybrid need a client."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "nlp":
        return extract_mentions
    if make_client is None:
        raise ValueError(f"mode {mode} needs a client")
    if mode == "llm":
        return lambda notes: _as_mentions(model_answers(notes, make_client, retries).where("mentions IS NOT NULL"))
    return lambda notes: hybrid(notes, make_client, max_chars, retries)[0]


def read_config(path: str) -> dict:
    """mode, llm_max_retries and hybrid_max_context_chars of a JSON file, with their defaults; unknown keys are an error."""
    config = {"mode": "nlp", "llm_max_retries": 2, "hybrid_max_context_chars": 2400}
    with open(path, encoding="utf-8") as source:
        given = json.load(source)
    if unknown := set(given) - set(config):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return config | given
