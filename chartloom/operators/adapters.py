"""Mentions from other tools and from language models, plausibility of mentions, relations by name, code search, risk input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions import lexicon as L
from chartloom.operators import validation as V
from chartloom.operators.lineage import fixed, merged

LLM_MENTION = "struct<text:string, entity_type:string, start_char:int, end_char:int, assertion:string, confidence_score:double, normalized_text:string, attributes:map<string,string>>"
BATCH_SCHEMA = f"note_id bigint, mentions array<{LLM_MENTION}>, error string"


def from_token_spans(spans: DataFrame) -> DataFrame:
    """Token-classification rows (word, start, end, entity_group, score, ...) as mentions; a missing score counts as 1."""
    renamed = {"word": "text", "start": "start_char", "end": "end_char", "entity_group": "entity_type"}
    rest = [c for c in spans.columns if c not in (*renamed, "score")]
    good = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.trim("word") != "") & F.col("entity_group").isNotNull()
    checked = F.when(good, F.col("word")).otherwise(F.raise_error(F.lit("a token span lacks word, start, end or entity_group")))
    return spans.select(*rest, checked.alias("text"), F.col("start").cast("int").alias("start_char"), F.col("end").cast("int").alias("end_char"), F.col("entity_group").alias("entity_type"), F.coalesce(F.col("score").cast("double"), F.lit(1.0)).alias("confidence_score"))


def from_labelled_spans(spans: DataFrame, assertion: str = "present", confidence: float = 1.0) -> DataFrame:
    """Spans of a pipeline (text, start_char, end_char, label, ...) as mentions; a label that is no entity type is an error."""
    from chartloom.operators.sessions import ENTITY_TYPES

    kind = F.when(F.col("label").isin(*ENTITY_TYPES), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no entity type: "), F.coalesce("label", F.lit("null")))))
    rest = [c for c in spans.columns if c != "label"]
    return spans.select(*rest, kind.alias("entity_type"), F.lit(assertion).alias("assertion"), F.lit(confidence).alias("confidence_score"))


def mention_ok(m: Column) -> Column:
    """The base record's rules: span of positive length, text that is not blank, confidence from 0 to 1."""
    span = (m["start_char"] >= 0) & (m["end_char"] > m["start_char"])
    return F.coalesce(span & (F.trim(m["text"]) != "") & m["confidence_score"].between(0, 1), F.lit(False))


def parse_batches(raw: DataFrame) -> DataFrame:
    """(note_id, raw) -> (note_id, mentions, error): JSON that is an array of mentions, or an object with `mentions`."""
    text = F.trim("raw")
    wrapped = F.when(text.startswith("["), F.concat(F.lit('{"mentions":'), text, F.lit("}"))).otherwise(text)
    parsed = F.from_json(wrapped, f"mentions array<{LLM_MENTION}>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.select("note_id", parsed.alias("p"))
    error = F.when(F.col("p._bad").isNotNull() | F.col("p.mentions").isNull(), "invalid-json").when(F.exists("p.mentions", lambda m: ~mention_ok(m)), "invalid-mention").when(F.exists("p.mentions", lambda m: ~plausible(m)), "implausible-value")
    return rows.select("note_id", F.col("p.mentions").alias("mentions"), error.alias("error"))


def implausible(m: Column) -> Column:
    """What is wrong with a mention's structured values, null where nothing is; values it does not carry are not judged."""
    get = lambda k: F.try_element_at(m["attributes"], F.lit(k))
    whole = lambda k: F.trim(get(k)).try_cast("bigint").cast("double")
    name, value = F.coalesce(m["normalized_text"], F.lit("")), get("value").isNotNull()
    measurement = F.lower(F.coalesce(get("measurement"), name))
    vital = m["entity_type"] == "vital"
    pressure, heart = vital & (measurement == "blood-pressure"), vital & F.contains(measurement, F.lit("heart"))
    say = lambda when, ok, what: F.when(when & ~F.coalesce(ok, F.lit(False)), what)
    rate = V.vital_ok(F.lit("heart-rate"), F.trim(get("value")).try_cast("double"), F.lit(None).cast("string"))
    others = F.coalesce(
        say((m["entity_type"] == "score") & value & get("scale").isNotNull(), V.score_ok(get("scale"), whole("value")), "the score is outside its scale"),
        say((name == "pain rating") & value, V.pain_ok(whole("value")), "the pain rating is not from 0 to 10"),
        say((name == "manual muscle test") & value, V.strength_grade(get("value")).isNotNull(), "the strength grade is not from 0 to 5"),
    )
    return F.when(pressure, say(F.lit(True), V.blood_pressure_ok(whole("systolic"), whole("diastolic")), "the blood pressure is not plausible")).when(heart, say(F.lit(True), rate, "the heart rate is not plausible")).otherwise(others)


def plausible(m: Column) -> Column:
    """A mention's structured values are within clinical ranges."""
    return implausible(m).isNull()


# Problems that a medication treats or a measurement measures.
TREATS = {
    "lisinopril": ("hypertension",), "metformin": ("type 2 diabetes mellitus",), "sertraline": ("major depressive disorder", "depression", "generalized anxiety disorder", "anxiety"),
    "fluoxetine": ("major depressive disorder", "depression", "generalized anxiety disorder", "anxiety"), "escitalopram": ("major depressive disorder", "depression", "generalized anxiety disorder", "anxiety"),
    "bupropion": ("major depressive disorder", "depression"), "duloxetine": ("major depressive disorder", "depression", "low back pain"), "albuterol": ("shortness of breath", "asthma"),
    "atorvastatin": ("hyperlipidemia",), "amlodipine": ("hypertension",), "losartan": ("hypertension",), "gabapentin": ("leg radiation", "low back pain"),
}
MEASURES = {
    "hemoglobin A1c": ("type 2 diabetes mellitus",), "Patient Health Questionnaire-9": ("major depressive disorder", "depression"), "Generalized Anxiety Disorder-7": ("generalized anxiety disorder", "anxiety"),
    "low density lipoprotein cholesterol": ("hyperlipidemia",), "high density lipoprotein cholesterol": ("hyperlipidemia",), "triglycerides": ("hyperlipidemia",), "total cholesterol": ("hyperlipidemia",),
}


def relation_rules(spark: SparkSession) -> DataFrame:
    """(source_name, relation, target_name, source_types): a table of a few dozen rows."""
    rows = [(n, "treats", t, ["medication"]) for n, ts in TREATS.items() for t in ts] + [(n, "measures", t, ["lab", "score", "vital"]) for n, ts in MEASURES.items() for t in ts]
    return fixed(spark, [*rows, ("safety plan", "supports", "suicidal ideation", ["risk"])], "source_name string, relation string, target_name string, source_types array<string>")


def named_relations(entities: DataFrame, key: str = "session_id") -> DataFrame:
    """entities(key, ord, entity_type, canonical_name) -> (key, source, relation, target): the first entity of each name a rule asks for."""
    rules = relation_rules(entities.sparkSession)
    s = entities.select(key, F.col("ord").alias("source"), "entity_type", F.col("canonical_name").alias("source_name")).join(rules, "source_name").where(F.array_contains("source_types", F.col("entity_type")))
    t = entities.groupBy(key, F.col("canonical_name").alias("target_name")).agg(F.min("ord").alias("target"))
    return s.join(merged(t), [key, "target_name"]).where("source <> target").select(key, "source", "relation", "target").distinct()


#: Queries from which on a filter counts as common.
COMMON = 50_000


def search_codes(codes: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """queries(query_id, filter) against codes(name, system, code, display): those whose name, code or display hold the filter,
    each system and code once, `limit` a query in order of name and code.

    Filters meet codes by an equi join on three signs (or on all of a shorter filter), and are then looked for as a whole.  What
    many queries ask is searched once, so that a common filter is no large group; a query of several filters gets what any finds.
    """
    said = F.lower(F.concat_ws(" ", "name", "code", "display"))
    grams = lambda c: F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))))
    held = codes.withColumn("_said", said)
    by_query = queries.where("filter IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set(F.lower("filter"))).alias("_asked"))
    counts = by_query.groupBy("_asked").agg((F.count("*") > COMMON).alias("_common"))
    asked = counts.withColumn("_filter", F.explode("_asked"))
    long, short = asked.where(F.length("_filter") >= 3), asked.where(F.length("_filter") < 3)
    by_gram = long.withColumn("_gram", F.substr("_filter", F.lit(1), F.lit(3))).join(held.withColumn("_gram", F.explode(grams(F.col("_said")))), "_gram").drop("_gram")
    # a filter of under three signs has no gram: its one or two signs are looked up among those of each code
    parts = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_said") - n + 1, F.lit(1))), lambda i: F.substr("_said", i, F.lit(n))))
    by_part = short.withColumn("_gram", F.col("_filter")).join(held.withColumn("_gram", F.explode(F.array_union(F.array_union(parts(1), parts(2)), F.array(F.lit(""))))), "_gram").drop("_gram")
    found = by_gram.unionByName(by_part).where(F.contains("_said", F.col("_filter"))).drop("_said", "_filter")
    once = found.withColumn("_k", F.row_number().over(Window.partitionBy("_asked", "system", "code").orderBy("name"))).where("_k = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("_asked").orderBy("name", "code"))).where(F.col("rank") <= limit)
    # a filter of many queries would be one task of a join by key; there are few of those, so what they find goes to the queries
    answers = ranked.select("_asked", "_common", "rank", "name", "code", "display")
    rare = by_query.join(F.broadcast(counts.where("_common").select("_asked")), "_asked", "left_anti").join(merged(answers.where("NOT _common")), "_asked")
    return by_query.join(F.broadcast(answers.where("_common")), "_asked").unionByName(rare).select("query_id", "rank", "name", "code", "display")


def resolved_risk_input(raw: DataFrame, names: Sequence[str] = tuple(n for n, *_ in L.RISK_FEATURES)) -> DataFrame:
    """Feature columns as given (null where absent) -> features with defaults, and which were coerced or are missing.

    An absent indicator is taken as 1; an absent value is 0 where its indicator is given as 1; any other gap is missing.
    """
    indicators = {n.removesuffix("__missing"): n for n in names if n.endswith("__missing")}
    coerced, missing, values = [], [], {}
    for n in names:
        value = F.when(V.finite(F.col(n)), F.col(n))
        if n.endswith("__missing"):
            values[n] = F.coalesce(value, F.lit(1.0))
            coerced.append(F.when(value.isNull(), F.lit(n)))
            continue
        measure = max((p for p in indicators if n == p or n.startswith(p + "_")), key=len, default=None)
        covered = F.coalesce(F.col(indicators[measure]) == 1, F.lit(False)) if measure else F.lit(False)
        values[n] = F.when(value.isNotNull(), value).when(covered, F.lit(0.0))
        coerced.append(F.when(value.isNull() & covered, F.lit(n)))
        missing.append(F.when(value.isNull() & ~covered, F.lit(n)))
    out = raw.withColumn("coerced", F.array_compact(F.array(*coerced))).withColumn("missing_required", F.array_compact(F.array(*missing)))
    return out.withColumns(values)
