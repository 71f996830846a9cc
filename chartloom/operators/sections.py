"""Section headings, and what section an offset lies in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions import lexicon as L
from chartloom.functions.spans import let, match_spans


def section_name(heading: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in L.SECTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(F.regexp_replace(heading, r"\s+", " ")))), F.lit("unknown"))


def section_title(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100))), " ")


def sections(text: Column) -> Column:
    """array<struct<title, name, start, end>>: text before the first heading is unknown; without a heading, all of it."""
    unknown = lambda end: F.struct(F.lit("Unsectioned note").alias("title"), F.lit("unknown").alias("name"), F.lit(0).alias("start"), end.alias("end"))

    def headed(v: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            return let(section_name(m["g2"]), lambda name: F.struct(section_title(name).alias("title"), name.alias("name"), m["end"].alias("start"), F.coalesce(F.try_element_at(v["starts"], i + 2), F.length(text)).alias("end")))

        named = F.filter(F.transform(v["found"], one), lambda s: s["start"] <= s["end"])
        first = F.try_element_at(v["starts"], F.lit(1))
        lead = (first > 0) & (F.trim(F.regexp_replace(text.substr(F.lit(1), first), r"\s+", " ")) != "")
        return F.when(lead, F.concat(F.array(unknown(first)), named)).otherwise(named)

    def placed(found: Column) -> Column:
        starts = F.transform(found, lambda m: m["start"] + F.length(F.coalesce(m["g1"], F.lit(""))))
        return F.when(F.size(found) == 0, F.array(unknown(F.length(text)))).otherwise(let(F.struct(found.alias("found"), starts.alias("starts")), headed))

    return let(match_spans(text, L.HEADING, 2), placed)


def section_at(spans: Column, offset: Column) -> Column:
    """The section that holds the offset, else the first."""
    inside = F.try_element_at(F.filter(spans, lambda s: (s["start"] <= offset) & (offset < s["end"])), F.lit(1))
    return F.coalesce(inside, F.try_element_at(spans, F.lit(1)))
