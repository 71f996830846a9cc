"""Assertion scoping: what the words around a mention say about it, as one ordered CASE over its sentence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import lexicon as L
from chartloom.functions.spans import any_of, before_first, behind_last, let, pieces


@dataclass(frozen=True)
class AssertionRules:
    """Trigger phrases; each list can be replaced."""

    pre_negation: tuple[str, ...] = L.PRE_NEGATION
    post_negation: tuple[str, ...] = L.POST_NEGATION
    hypothetical: tuple[str, ...] = L.HYPOTHETICAL
    family_history: tuple[str, ...] = L.FAMILY_HISTORY
    historical: tuple[str, ...] = L.HISTORICAL
    post_historical: tuple[str, ...] = L.POST_HISTORICAL
    possible: tuple[str, ...] = L.POSSIBLE
    termination: tuple[str, ...] = L.TERMINATION
    chronic: tuple[str, ...] = L.CHRONIC
    post_scope: int = L.POST_SCOPE


def _last(scope: Column, pattern: str) -> Column:
    return F.trim(F.try_element_at(F.regexp_extract_all(scope, F.lit(pattern), F.lit(0)), F.lit(-1)))


def _first(scope: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(scope, pattern, 0)), F.lit(""))


def resolve(rows: DataFrame, rules: AssertionRules = AssertionRules()) -> DataFrame:
    """rows with before and after (the sentence's text on either side of the mention) gain assertion, decision, trigger.

    An `assertion` the rows bring along is the default; without one it is "present".  The first rule that applies decides:
    family history, conditional, hypothetical, historical (or chronic but managed), historical after the mention, possible,
    negation before, negation after, a cue too far behind the mention, default.
    """
    end, scope_end = any_of(rules.termination), rules.post_scope
    negated = any_of(rules.pre_negation)
    incoming = F.col("assertion") if "assertion" in rows.columns else F.lit("present")
    rows = rows.withColumn("_in", incoming).withColumn("_scope", behind_last(F.col("before"), end))
    rows = rows.withColumn("_open", before_first(F.col("after"), end)).withColumn("_near", before_first(F.substring("after", 1, scope_end), end))
    scope, ahead, near = F.col("_scope"), F.col("_open"), F.col("_near")

    not_only = scope.rlike(r"(?i)\bnot\s+only\b")
    pre = _last(scope, negated)
    rows = rows.withColumn("_pre", F.when((F.lower(pre) == "not") & not_only, F.lit(None)).otherwise(pre))

    def unless_negated(phrases: tuple[str, ...]) -> Column:
        """struct<trigger, negated, said>: the last trigger, whether a negation stands before it, the text up to its end."""
        pattern = any_of(phrases)

        def told(v: Column) -> Column:
            raw = F.try_element_at(v["found"], F.lit(-1))
            upto = F.length(scope) - F.length(F.element_at(v["between"], -1))
            said = F.trim(scope.substr(F.lit(1), upto))
            head = scope.substr(F.lit(1), upto - F.length(raw))
            return F.struct(F.trim(raw).alias("trigger"), head.rlike(negated).alias("negated"), F.when(F.length(said) > 60, F.right(said, F.lit(60))).otherwise(said).alias("said"))

        found = F.regexp_extract_all(scope, F.lit(pattern), F.lit(0))
        return F.when(scope.rlike(pattern), let(F.struct(found.alias("found"), pieces(scope, pattern).alias("between")), told))

    backward = any_of(tuple(dict.fromkeys(rules.post_negation + rules.post_historical)))
    chronic = F.lower(F.trim(F.coalesce(F.nullif("normalized_text", F.lit("")), F.col("text")))).isin(*rules.chronic) & F.col("after").rlike(L.MANAGEMENT)
    # each trigger is a column of its own, so that it is looked for once a mention
    for name, value in {
        "_family": unless_negated(rules.family_history),
        "_circumstance": _first(ahead, L.CIRCUMSTANCE),
        "_hypothetical": _last(scope, any_of(rules.hypothetical)),
        "_past": unless_negated(rules.historical),
        "_post_past": _first(near, any_of(rules.post_historical)),
        "_possible": _last(scope, any_of(rules.possible)),
        "_post_negation": _first(near, any_of(rules.post_negation)),
        "_unbound": F.when(F.length(before_first(ahead, backward)) >= scope_end, _first(ahead, backward)),
    }.items():
        rows = rows.withColumn(name, value)
    family, past = F.col("_family.trigger"), F.col("_past.trigger")
    circumstance, hypothetical, possible = F.col("_circumstance"), F.col("_hypothetical"), F.col("_possible")
    post_past, post_negation, unbound = F.col("_post_past"), F.col("_post_negation"), F.col("_unbound")

    steps: list[tuple[Column, Column | str, str, Column]] = [
        (family.isNotNull() & F.col("_family.negated"), "absent", "pre-negation", F.col("_family.said")),
        (family.isNotNull(), "family-history", "family-history", family),
        (F.col("_pre").isNull() & circumstance.isNotNull(), "conditional", "conditional", circumstance),
        (hypothetical.isNotNull(), "hypothetical", "hypothetical", hypothetical),
        (past.isNotNull() & F.col("_past.negated"), "absent", "pre-negation", F.col("_past.said")),
        (past.isNotNull() & chronic, "present", "chronic-active-present", past),
        (past.isNotNull(), "historical", "historical", past),
        (post_past.isNotNull(), "historical", "post-historical", post_past),
        (possible.isNotNull(), "possible", "possible", possible),
        (F.col("_pre").isNotNull(), "absent", "pre-negation", F.col("_pre")),
        (post_negation.isNotNull(), "absent", "post-negation", post_negation),
        (unbound.isNotNull(), "unknown", "unresolved", unbound),
        (F.col("_in") == "unknown", "unknown", "unresolved", F.lit(None).cast("string")),
    ]
    result = None
    for when, assertion, decision, trigger in steps:
        value = F.struct(F.lit(assertion).alias("assertion"), F.lit(decision).alias("decision"), trigger.alias("trigger"))
        result = F.when(when, value) if result is None else result.when(when, value)
    default = F.struct(F.col("_in").alias("assertion"), F.lit("default-present").alias("decision"), F.lit(None).cast("string").alias("trigger"))
    out = rows.withColumn("_r", result.otherwise(default))
    for c in ("assertion", "decision", "trigger"):
        out = out.withColumn(c, F.col(f"_r.{c}"))
    out = out.withColumn("assertion_reason", F.concat_ws(": ", "decision", "trigger"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])
