"""A second look at a note's entities: issues with their values, blocks routed to rules or to a model, and the excerpt for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phrases that send a sentence to a model, wherever they stand, in the order in which they are tried.
LLM_TRIGGERS = ("family history", "family hx", "mother", "father", "sister", "brother", "rule out", "r/o", "concern for", "differential", "unclear", "complex")


def number(c: Column) -> Column:
    """A text as a number; null for none, for a blank or for what is no finite number."""
    value = F.expr("NULL").cast("double") if c is None else F.nullif(F.trim(c), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def pain_severity(attributes: Column) -> Column:
    """Severity as a number, else the n of a value n/10, else the value as a number."""
    get = lambda k: F.try_element_at(attributes, F.lit(k))
    of_ten = F.nullif(F.regexp_extract(F.coalesce(get("value"), F.lit("")), r"^([0-9]+(?:\.[0-9]+)?)/10$", 1), F.lit(""))
    return F.coalesce(number(get("severity")), number(F.coalesce(of_ten, get("value"))))


def shown(value: Column) -> Column:
    """A number without a decimal part where it has none."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def issues(entities: DataFrame) -> DataFrame:
    """entities(note_id, ord, canonical_name, display_name, confidence, attributes, ...) -> (note_id, ord, k, severity, message)."""
    get = lambda k: number(F.try_element_at("attributes", F.lit(k)))
    value, systolic, diastolic, pain = get("value"), get("systolic"), get("diastolic"), pain_severity(F.col("attributes"))

    def outside(name: str, v: Column, low: int, high: int, said: Column) -> Column:
        return F.when((F.col("canonical_name") == name) & ~v.between(low, high), F.struct(F.lit("error").alias("severity"), said.alias("message")))

    text = lambda before, v, after: F.concat(F.lit(before), shown(v), F.lit(after))
    error = lambda when, said: F.when(when, F.struct(F.lit("error").alias("severity"), F.lit(said).alias("message")))
    found = F.array_compact(
        F.array(
            outside("blood pressure", systolic, 40, 300, text("Systolic BP ", systolic, " is outside 40-300.")),
            outside("blood pressure", diastolic, 20, 200, text("Diastolic BP ", diastolic, " is outside 20-200.")),
            error((F.col("canonical_name") == "blood pressure") & (systolic <= diastolic), "Systolic BP should exceed diastolic BP."),
            outside("heart rate", value, 20, 300, text("Heart rate ", value, " is outside 20-300.")),
            outside("Patient Health Questionnaire-9", value, 0, 27, text("PHQ-9 ", value, " is outside 0-27.")),
            outside("Generalized Anxiety Disorder-7", value, 0, 21, text("GAD-7 ", value, " is outside 0-21.")),
            outside("pain rating", pain, 0, 10, text("Pain rating ", pain, "/10 is outside 0-10.")),
            F.when(F.col("confidence") == "low", F.struct(F.lit("warning").alias("severity"), F.lit("Low-confidence extraction should be reviewed before model use.").alias("message"))),
        )
    )
    return entities.select("note_id", "ord", F.posexplode(found).alias("k", "i")).select("note_id", "ord", "k", "i.severity", "i.message")


def plain_sentences(text: Column) -> Column:
    """Sentences cut at white space after . ! ? and at line ends, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+", -1), lambda s: F.trim(s)), lambda s: s != "")


def trigger_of(sentence: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(sentence), F.lit(t)), t) for t in LLM_TRIGGERS])


def triage_blocks(notes: DataFrame, entities: DataFrame, rules: int = 6, checked: int = 4) -> DataFrame:
    """(note_id, place, route, reason, excerpt): the first `rules` entities, the first `checked` issues, then trigger sentences.

    entities: as for issues, with entity_type and sentence (of the first mention).  Equal blocks are kept once, the first.
    """
    w = Window.partitionBy("note_id")
    excerpt = F.coalesce("sentence", "display_name")
    first = entities.withColumn("n", F.row_number().over(w.orderBy("ord"))).where(F.col("n") <= rules)
    middle = F.lit(" \u00b7 ")
    own = first.select("note_id", F.struct(F.lit(0).alias("part"), F.col("n")).alias("at"), F.lit("Rules").alias("route"), F.concat("entity_type", middle, "confidence", F.lit(" confidence")).alias("reason"), excerpt.alias("excerpt"))
    found = issues(entities).withColumn("n", F.row_number().over(w.orderBy("ord", "k"))).where(F.col("n") <= checked)
    known = entities.select("note_id", "ord", excerpt.alias("excerpt"))
    wrong = found.join(known, ["note_id", "ord"]).select("note_id", F.struct(F.lit(1).alias("part"), F.col("n")).alias("at"), F.lit("LLM").alias("route"), F.col("message").alias("reason"), "excerpt")
    said = notes.select("note_id", F.posexplode(plain_sentences(F.col("text"))).alias("n", "excerpt")).withColumn("trigger", trigger_of(F.col("excerpt"))).where("trigger IS NOT NULL")
    complex_ = said.select("note_id", F.struct(F.lit(2).alias("part"), F.col("n")).alias("at"), F.lit("LLM").alias("route"), F.concat(F.lit("Complex context trigger: "), "trigger").alias("reason"), "excerpt")
    every = own.unionByName(wrong).unionByName(complex_)
    once = every.groupBy("note_id", "route", "reason", "excerpt").agg(F.min("at").alias("at"))
    return once.withColumn("place", F.row_number().over(w.orderBy("at"))).select("note_id", "place", "route", "reason", "excerpt")


def compressed_context(notes: DataFrame, entities: DataFrame, blocks: DataFrame, first: int = 4, budget: int = 700) -> DataFrame:
    """(note_id, context): excerpts routed to the model, then the sentences of the first entities, each once; else the note's start."""
    asked = blocks.where("route = 'LLM'").select("note_id", F.struct(F.lit(0).alias("part"), F.col("place").alias("n")).alias("at"), F.trim("excerpt").alias("line"))
    w = Window.partitionBy("note_id").orderBy("ord")
    own = entities.withColumn("n", F.row_number().over(w)).where(F.col("n") <= first).where("sentence IS NOT NULL")
    own = own.select("note_id", F.struct(F.lit(1).alias("part"), F.col("n")).alias("at"), F.trim("sentence").alias("line"))
    lines = asked.unionByName(own).where("line <> ''").groupBy("note_id", "line").agg(F.min("at").alias("at"))
    text = lines.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("context"))
    return notes.select("note_id", "text").join(text, "note_id", "left").select("note_id", F.coalesce("context", F.substring(F.trim("text"), 1, budget)).alias("context"))


def snapshot(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """(note_id, n_rules, n_llm, n_issues): entities handled by rules, blocks routed to a model, issues found."""
    rules = entities.groupBy("note_id").agg(F.count("*").alias("n_rules"))
    llm = blocks.groupBy("note_id").agg(F.count_if(F.col("route") == "LLM").alias("n_llm"))
    wrong = issues(entities).groupBy("note_id").agg(F.count("*").alias("n_issues"))
    out = rules.join(llm, "note_id", "full").join(wrong, "note_id", "left")
    return out.select("note_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_rules", "n_llm", "n_issues")])
