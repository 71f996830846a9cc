"""Leakage-safe temporal features of mentions, and the note-level risk features and score."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import lexicon as L
from chartloom.operators.lineage import merged
from chartloom.operators.rollup import canonical


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    entity_type: str
    normalized_text: str | None = None
    numeric_attribute: str | None = "value"
    lookback_days: int = 365
    assertion_counts: bool = True
    missing_indicator: bool = True


DEFAULT_SPECS = (
    FeatureSpec("heart_rate", "vital", "heart rate"),
    FeatureSpec("pain_rating", "severity", "pain rating"),
    FeatureSpec("phq9", "score", "PHQ-9"),
    FeatureSpec("suicidal_ideation", "risk", "suicidal ideation"),
)


def feature_matrix(records: DataFrame, index: DataFrame, specs: Sequence[FeatureSpec] = DEFAULT_SPECS) -> DataFrame:
    """One wide row a prediction: for every spec, counts by assertion, last/min/max/mean of present values, indicators.

    records: mentions with patient_id, observed_at and ord (input order); index: patient_id, visit_id, prediction_time.  A
    mention counts in [prediction_time - lookback, prediction_time): nothing of the visit itself or after it.  One range
    join over the longest lookback serves all specs; each spec then is conditional aggregation.  The join is by patient and
    span of that lookback: a prediction looks into its own span and the one before, so a patient's long history is dealt
    over many keys.
    """
    longest = max(s.lookback_days for s in specs)
    wanted, fits, read = None, [], {}
    for k, s in enumerate(specs):
        one = F.col("entity_type") == s.entity_type
        one = one & (canonical() == s.normalized_text.lower()) if s.normalized_text else one
        wanted = one if wanted is None else wanted | one
        fits.append(one.alias(f"_fits{k}"))
        if s.numeric_attribute and s.numeric_attribute not in read:
            read[s.numeric_attribute] = F.expr(f"try_cast(attributes['{s.numeric_attribute}'] AS DOUBLE)").alias(f"_number{len(read)}")
    place = {name: f"_number{i}" for i, name in enumerate(read)}
    # only what the aggregates read is joined, as flags and numbers: a mention meets every later visit of its patient
    r = records.where(wanted).select(F.col("patient_id").alias("r_patient"), "observed_at", "ord", "assertion", *fits, *read.values())
    span_of = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(longest * 86_400_000_000))
    r = r.withColumn("r_span", span_of(F.col("observed_at")))
    index = index.withColumn("_span", span_of(F.col("prediction_time"))).withColumn("_span", F.explode(F.array(F.col("_span") - 1, F.col("_span"))))
    near = (F.col("patient_id") == F.col("r_patient")) & (F.col("_span") == F.col("r_span")) & (F.col("observed_at") < F.col("prediction_time")) & (F.col("observed_at") >= F.expr(f"prediction_time - INTERVAL {longest} DAYS"))
    joined = index.join(merged(r), near, "left")
    columns: dict[str, Column] = {}
    for k, s in enumerate(specs):
        mine = F.col(f"_fits{k}") & (F.col("observed_at") >= F.expr(f"prediction_time - INTERVAL {s.lookback_days} DAYS"))
        mine = F.coalesce(mine, F.lit(False))
        present, absent = mine & (F.col("assertion") == "present"), mine & (F.col("assertion") == "absent")
        if s.assertion_counts:
            columns[f"{s.name}__present_count"] = F.count_if(present)
            columns[f"{s.name}__absent_count"] = F.count_if(absent)
            columns[f"{s.name}__possible_count"] = F.count_if(mine & F.col("assertion").isin("possible", "hypothetical"))
        number = F.when(present, F.col(place[s.numeric_attribute])) if s.numeric_attribute else F.lit(None).cast("double")
        columns[f"{s.name}__last"] = F.max_by(number, F.when(number.isNotNull(), F.struct("observed_at", "ord")))
        columns[f"{s.name}__min"], columns[f"{s.name}__max"], columns[f"{s.name}__mean"] = F.min(number), F.max(number), F.avg(number)
        if s.missing_indicator:
            columns[f"{s.name}__missing"] = F.count_if(mine) == 0
            columns[f"{s.name}__explicitly_negated"] = (F.count_if(absent) > 0) & (F.count_if(present) == 0)
    keys = ("patient_id", "visit_id", "prediction_time")
    return joined.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()]).select(*keys, *sorted(columns))


def risk_features(mentions: DataFrame) -> DataFrame:
    """note-level vector of the risk model's features from mentions (review priority high: conflicting or unknown)."""
    name, absent = canonical(), F.col("assertion") == "absent"
    number = lambda key: F.expr(f"try_cast(attributes['{key}'] AS DOUBLE)")
    of = lambda n: (name == n) & ~absent
    place = F.struct("start_char", "end_char")
    bp = name == "blood pressure"
    si = name == "suicidal ideation"
    out = mentions.groupBy("note_id").agg(
        F.count("*").cast("double").alias("entity_count"),
        F.count_if(~absent & F.col("entity_type").isin("problem", "symptom", "finding", "risk")).cast("double").alias("problem_count_present"),
        F.count_if(~absent & (F.col("entity_type") == "medication")).cast("double").alias("medication_count"),
        F.count_if(~absent & F.col("entity_type").isin("plan", "referral", "procedure", "imaging")).cast("double").alias("plan_count"),
        F.count_if(~absent & (F.col("entity_type") == "functional-limitation")).cast("double").alias("functional_limitation_count"),
        F.count_if(F.col("assertion").isin("conflicting", "unknown")).cast("double").alias("high_priority_count"),
        F.max_by(F.when(of("pain rating"), number("value")), F.when(of("pain rating"), place)).alias("pain"),
        F.avg(F.when(of("heart rate"), number("value"))).alias("hr"),
        F.max_by(F.when(bp, number("systolic")), F.when(bp, place)).alias("sys"),
        F.max_by(F.when(bp, number("diastolic")), F.when(bp, place)).alias("dia"),
        F.max(F.when(of("phq-9"), number("value"))).alias("phq"),
        F.max(F.when(of("gad-7"), number("value"))).alias("gad"),
        F.max((si & ~absent).cast("double")).alias("si__present"),
        F.max((si & absent).cast("double")).alias("si__explicitly_negated"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    missing = lambda c: c.isNull().cast("double")
    values = {
        "pain_rating__last": zero("pain"), "pain_rating__missing": missing(F.col("pain")), "heart_rate__mean": F.round(zero("hr"), 1), "heart_rate__missing": missing(F.col("hr")),
        "bp_systolic__last": zero("sys"), "bp_diastolic__last": zero("dia"), "bp_missing": (F.col("sys").isNull() | F.col("dia").isNull()).cast("double"),
        "phq9__max": zero("phq"), "phq9__missing": missing(F.col("phq")), "gad7__max": zero("gad"),
    }
    out = out.withColumns(values)
    return out.select("note_id", *[n for n, *_ in L.RISK_FEATURES])


def normalised(name: str, center: float, scale: float) -> Column:
    """A feature's value in units of its scale from its center; 0 where it is missing or not finite."""
    return _contribution(name, 1.0, center, scale)


def _contribution(name: str, weight: float, center: float, scale: float) -> Column:
    value = F.col(name)
    if name == "heart_rate__mean":
        value = F.when(F.col("heart_rate__missing") == 1, F.lit(center)).otherwise(value)
    if name in ("bp_systolic__last", "bp_diastolic__last"):
        value = F.when(F.col("bp_missing") == 1, F.lit(center)).otherwise(value)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, (value - center) / scale * weight).otherwise(0.0)


@dataclass(frozen=True)
class RiskModel:
    """features: (name, weight, center, scale) in order."""

    intercept: float = L.RISK_INTERCEPT
    features: tuple[tuple[str, float, float, float], ...] = L.RISK_FEATURES
    decision: float = L.RISK_DECISION
    low: float = L.RISK_LOW
    high: float = L.RISK_HIGH


def read_risk_model(path: str) -> RiskModel:
    """A model file: JSON with featureNames, intercept, weights, normalization (center, scale) and thresholds; a scale of 0 is an error."""
    with open(path, encoding="utf-8") as source:
        raw = json.load(source)
    features = []
    for name in raw["featureNames"]:
        norm = raw["normalization"].get(name, {"center": 0.0, "scale": 1.0})
        if not norm["scale"]:
            raise ValueError(f"scale of {name} is 0")
        features.append((name, float(raw["weights"].get(name, 0.0)), float(norm["center"]), float(norm["scale"])))
    cut = raw["thresholds"]
    return RiskModel(float(raw["intercept"]), tuple(features), float(cut["decision"]), float(cut["low"]), float(cut["high"]))


def risk_score(features: DataFrame, model: RiskModel = RiskModel()) -> DataFrame:
    """features gain raw_probability, probability (3 digits), band, decision and the strongest drivers."""
    parts = [(n, _contribution(n, w, c, s)) for n, w, c, s in model.features]
    logit = F.lit(model.intercept)
    for _, c in parts:
        logit = logit + c
    out = features.withColumn("raw_probability", 1 / (1 + F.exp(-logit))).withColumn("probability", F.round("raw_probability", 3))
    out = out.withColumn("band", F.when(F.col("probability") >= model.high, "high").when(F.col("probability") >= model.low, "moderate").otherwise("low"))
    out = out.withColumn("decision", F.when(F.col("probability") >= model.decision, "above-threshold").otherwise("below-threshold"))
    drivers = F.array(*[F.struct((-F.abs(c)).alias("rank"), F.lit(k).alias("ord"), F.lit(n).alias("feature"), c.alias("value")) for k, (n, c) in enumerate(parts)])
    top = F.slice(F.array_sort(F.filter(drivers, lambda d: d["rank"] <= -0.08)), 1, 5)
    text = F.array_join(F.transform(top, lambda d: F.concat(d["feature"], F.lit(" "), F.format_string("%+.2f", d["value"]))), "; ")
    return out.withColumn("drivers", F.when(F.size(top) > 0, text).otherwise("No elevated model drivers from extracted features"))
