"""Plausibility checks of measurements, scores and grades: columns, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible ranges of vitals (temperature by unit), and of scores by scale.
VITAL_RANGES = {"heart-rate": (20.0, 300.0), "respiratory-rate": (4.0, 80.0), "systolic-bp": (40.0, 300.0), "diastolic-bp": (20.0, 200.0), "oxygen-saturation": (0.0, 100.0), "body-mass-index": (5.0, 100.0)}
TEMPERATURE_RANGES = {"C": (25.0, 45.0), "F": (77.0, 113.0)}
SCORE_RANGES = {"phq-9": (0, 27), "gad-7": (0, 21), "audit-c": (0, 12), "cssrs": (0, 25), "c-ssrs": (0, 25), "tug": (0, 300), "5xsts": (0, 300)}
OTHER_SCORES = (0, 10_000)


def _within(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value <= high)


def _any(key: Column, ranges: dict, value: Column, otherwise: Column) -> Column:
    out = None
    for k, (low, high) in ranges.items():
        out = F.when(key == k, _within(value, low, high)) if out is None else out.when(key == k, _within(value, low, high))
    return out.otherwise(otherwise)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def temperature_unit(unit: Column) -> Column:
    """C, F (where the unit is null too), or null for a unit that is neither."""
    u = F.lower(F.trim(unit))
    return F.when(unit.isNull() | u.isin("f", "degf", "fahrenheit", "°f"), "F").when(u.isin("c", "cel", "celsius", "°c"), "C")


def vital_ok(kind: Column, value: Column, unit: Column) -> Column:
    u = temperature_unit(unit)
    degrees = F.coalesce(_any(u, TEMPERATURE_RANGES, value, F.lit(False)), F.lit(False))
    return finite(value) & F.when(kind == "temperature", degrees).otherwise(_any(kind, VITAL_RANGES, value, F.lit(False)))


def blood_pressure_ok(systolic: Column, diastolic: Column) -> Column:
    return F.coalesce(_within(systolic, 40, 300) & _within(diastolic, 20, 200) & (systolic > diastolic), F.lit(False))


def lab_ok(name: Column, value: Column, low: Column, high: Column) -> Column:
    bounds = F.coalesce(low < high, F.lit(True))
    negative = (value < 0) & (F.lower(F.trim(name)) != "base excess")
    return F.coalesce((F.trim(name) != "") & finite(value) & bounds & ~negative, F.lit(False))


def score_ok(scale: Column, value: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(scale)), " ", ""), "_", "-")
    return F.coalesce((F.trim(scale) != "") & _any(key, SCORE_RANGES, value, _within(value, *OTHER_SCORES)), F.lit(False))


def pain_ok(value: Column) -> Column:
    return F.coalesce(_within(value, 0, 10), F.lit(False))


def motion_ok(movement: Column, degrees: Column) -> Column:
    return F.coalesce((F.trim(movement) != "") & _within(degrees, 0, 360), F.lit(False))


def strength_grade(raw: Column) -> Column:
    """0 to 5 with +/- 0.3 for a sign; null for what is no grade or falls outside."""
    grade = F.regexp_extract(F.trim(raw), r"^([0-5])\s*([+-]?)\s*(?:/\s*5)?\z", 1)
    sign = F.regexp_extract(F.trim(raw), r"^([0-5])\s*([+-]?)\s*(?:/\s*5)?\z", 2)
    value = F.expr("NULL").cast("double") if grade is None else F.when(grade != "", grade.cast("double") + F.when(sign == "+", 0.3).when(sign == "-", -0.3).otherwise(0.0))
    return F.when((value >= 0) & (value <= 5), value)


def confidence_number(label: Column) -> Column:
    return F.when(label == "high", 0.8).when(label == "medium", 0.6).when(label == "low", 0.4).otherwise(0.5)


def confidence_label(value: Column, high: float = 0.85, medium: float = 0.6) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")
