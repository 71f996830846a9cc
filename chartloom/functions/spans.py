"""Matches with offsets, sentences and span algebra, as column expressions.

Spark has no function that gives all matches with their places.  The pieces between matches (split) and the matches
(regexp_extract_all) of one pattern alternate, so a match starts where the pieces and matches before it end.
Offsets count code points from 0 and are half-open.  Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.literals import may_match

SENTENCE_END = r"[.!?](?=\s|$)|\n+"


def any_of(phrases: list[str] | tuple[str, ...]) -> str:
    """A pattern of any phrase, longest first, not inside a word, ignoring case; white space in it matches any run."""
    if not phrases:
        return r"a\A"
    special = set(r"\.^$*+?{}[]|()/")
    escaped = ["".join("\\s+" if c == " " else "\\" + c if c in special else c for c in p) for p in sorted(phrases, key=len, reverse=True)]
    return "(?i)(?<![A-Za-z0-9])(?:" + "|".join(escaped) + ")(?![A-Za-z0-9])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: inside a lambda, Spark would evaluate an expression anew at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


_LAST = "coalesce(try_element_at({0}, -1), 0)"
_GATHERED = "aggregate({0}, cast(array() AS array<int>), (a, x) -> array_append(a, " + _LAST.format("a") + " + x))"
_BEFORE = _GATHERED.format("transform(runs, r -> " + _LAST.format("r") + ")")
_MOVED = f"transform(runs, (r, k) -> element_at(transform(array(CASE WHEN k > 0 THEN get({_BEFORE}, k - 1) ELSE 0 END), b -> transform(r, x -> x + b)), 1))"
_RUNS = "transform(sequence(1, size(own), 128), at -> " + _GATHERED.format("slice(own, at, 128)") + ")"
#: Running sums of the lambda variable own.
_RUNNING = f"CASE WHEN size(own) <= 128 THEN {_GATHERED.format('own')} ELSE element_at(transform(array({_RUNS}), runs -> flatten({_MOVED})), 1) END"


def _bound(value: Column, function: str) -> Column:
    """let() with the body as SQL, a lambda of one variable: a long body costs one call to the JVM instead of one a node."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(function)), 1)


def running(steps: Column) -> Column:
    """The running sums of an array of ints.

    Sums are gathered within runs of 128 and then moved by the sums of the runs before, so that a long array is not copied
    anew at every element.
    """
    return F.when(steps.isNotNull(), _bound(steps, f"own -> {_RUNNING}"))


_MARK = "\x01"


def pieces(text: Column, pattern: str) -> Column:
    """The texts between all matches.

    split compiles its pattern anew at each row, where replacing keeps it; so matches become marks, which need no pattern, and only a
    text that holds the mark itself is split by the pattern.
    """
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1))


def before_first(text: Column, pattern: str) -> Column:
    """The text before the first match, all of it where there is none."""
    return F.when(text.rlike(pattern), F.element_at(F.split(text, pattern, 2), 1)).otherwise(text)


def behind_last(text: Column, pattern: str) -> Column:
    """The text behind the last match, all of it where there is none."""
    return F.when(text.rlike(pattern), F.element_at(F.split(text, pattern, -1), -1)).otherwise(text)


def match_spans(text: Column, pattern: str, groups: int = 0, lowered: Column | None = None) -> Column:
    """array<struct<start, end, text, g1..gn>> of all matches of a pattern, in order; unmatched groups are null.

    lowered: the text in lower case, where it is at hand.  A match ends at the running sum of the lengths of pieces and matches.  A text without a literal that every match holds costs no
    search by the pattern, and one without a match costs one.
    """
    names = [f"c{k}" for k in range(1, groups + 1)]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    between = pieces(text, pattern).alias("between")
    columns = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names, 1)]
    own = "".join(f", g{k}: string" for k in range(1, groups + 1))
    none = F.array().cast(f"array<struct<start: int, end: int, text: string{own}>>")
    steps = "transform(v.found, (x, i) -> length(get(v.between, i)) + length(x))"
    ends = f"element_at(transform(array({steps}), own -> {_RUNNING}), 1)"
    captured = "".join(f", 'g{k}', nullif(get(v.{n}, i), '')" for k, n in enumerate(names, 1))
    one = f"named_struct('start', get(e, i) - length(x), 'end', get(e, i), 'text', x{captured})"
    spans = _bound(F.struct(found, between, *columns), f"v -> element_at(transform(array({ends}), e -> transform(v.found, (x, i) -> {one})), 1)")
    return F.when(text.isNull(), F.lit(None)).when(may_match(text, pattern, lowered) & text.rlike(pattern), spans).otherwise(none)


def _trimmed(start: Column, raw: Column) -> Column:
    def cut(v: Column) -> Column:
        first = start + F.length(raw) - F.length(v)
        return let(F.regexp_replace(v, r"\s+$", ""), lambda body: F.struct(first.alias("start"), (first + F.length(body)).alias("end"), body.alias("text")))

    return let(F.regexp_replace(raw, r"^\s+", ""), cut)


def sentence_spans(text: Column, boundary: str = SENTENCE_END) -> Column:
    """array<struct<start, end, text>> of the trimmed, non-blank sentences; the whole text where there is none."""
    ends = F.regexp_extract_all(text, F.lit(boundary), F.lit(0)).alias("ends")
    between = pieces(text, boundary).alias("pieces")

    def placed(raw: Column) -> Column:
        behind = running(F.transform(raw, lambda r: F.length(r)))
        cut = let(behind, lambda b: F.transform(raw, lambda r, i: _trimmed(F.get(b, i) - F.length(r), r)))
        return F.filter(cut, lambda s: s["end"] > s["start"])

    raw = let(F.struct(between, ends), lambda v: F.transform(v["pieces"], lambda p, i: F.concat(p, F.coalesce(F.get(v["ends"], i), F.lit("")))))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text")))
    return let(let(raw, placed), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def containing(spans: Column, offset: Column) -> Column:
    """The first span that holds an offset, or null."""
    return F.try_element_at(F.filter(spans, lambda s: (s["start"] <= offset) & (offset < s["end"])), F.lit(1))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def char_jaccard(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared over covered characters of two spans; 0 when they are apart."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.when(shared == 0, F.lit(0.0)).otherwise(shared / (F.greatest(a_end, b_end) - F.least(a_start, b_start)))


def overlap_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Token-set Jaccard: 1 when both are empty, 0 when one is."""
    x, y = overlap_tokens(a), overlap_tokens(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)
