"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is (role, parts); a part is (type, text, ref, units).  A visitor over the parts writes text parts as they are
(escaped) and image, audio and document parts as ordered placeholders `<|type:n|>`, n counting the conversation's
attachments from 0, and records for each the reference and its expanded token count: units (1 where null) times the
type's tokens a unit.  Parts of any other type are written as text.

Template.  A turn is `<|turn|>role<|text|>content<|end|>`.  Inside roles and texts `\\`, `<` and `[` are written `\\b`, `\\l` and
`\\s`, so that no control string of this template or of the common ones can stand in a text, and every text can be read
back: the three codes are undone in the order l, s, b.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENS_A_UNIT: dict[str, int] = {"image": 576, "audio": 50, "document": 800}
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "struct<type string, text string, ref string, units bigint>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\s"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("[")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a message."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    return F.array(part)


def _attached(p: Column, kinds: Mapping[str, int]) -> Column:
    return F.coalesce(p["type"].isin(*kinds), F.lit(False))


def format_conversations(messages: DataFrame, tokens_a_unit: Mapping[str, int] = TOKENS_A_UNIT) -> DataFrame:
    """messages(conv_id, turn, role, parts array<type, text, ref, units>) -> one row a conversation:

    (conv_id, formatted, n_turns, loss_spans array<start, size>, attachments array<n, type, ref, tokens>,
    expanded_tokens).  Spans count code points from 0 and cover the escaped texts of the assistant's text parts.

    Turns are in order of turn (nulls first), ties by role and content, so that repeated rows stay repeated turns.  Null
    roles, parts and texts are empty; a null conv_id is a conversation of its own; an empty table gives no rows.
    """
    kinds = dict(tokens_a_unit)
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    plain = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "\n")
    rows = rows.withColumn("tie", plain).withColumn("n_own", F.size(F.filter("parts", lambda p: _attached(p, kinds))))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.row_number().over(in_order)).withColumn("first", F.coalesce(F.sum("n_own").over(before), F.lit(0)))

    def number(i: Column) -> Column:
        return F.col("first") + F.size(F.filter(F.slice("parts", F.lit(1), i), lambda p: _attached(p, kinds)))

    def visited(p: Column, i: Column) -> Column:
        placeholder = F.concat(F.lit("<|"), p["type"], F.lit(":"), number(i).cast("string"), F.lit("|>"))
        return F.struct(F.when(_attached(p, kinds), placeholder).otherwise(escaped(F.coalesce(p["text"], F.lit("")))).alias("out"), _attached(p, kinds).alias("attached"))

    rows = rows.withColumn("pieces", F.transform("parts", visited))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("head", head).withColumn("turn_text", F.concat("head", F.array_join("pieces.out", ""), F.lit(END)))
    rows = rows.withColumn("from", F.coalesce(F.sum(F.length("turn_text")).over(before), F.lit(0)))

    def span(p: Column, i: Column) -> Column:
        offset = F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["out"]))
        return F.struct((F.col("from") + F.length("head") + offset).cast("bigint").alias("start"), F.length(p["out"]).cast("bigint").alias("size"), p["attached"].alias("attached"))

    spans = F.when(F.col("role") == "assistant", F.filter(F.transform("pieces", span), lambda s: ~s["attached"])).otherwise(F.array().cast("array<struct<start bigint, size bigint, attached boolean>>"))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size")))


    def attachment(p: Column, i: Column) -> Column:
        each = F.lit(0)
        for kind, n in kinds.items():
            each = F.when(p["type"] == kind, F.lit(n)).otherwise(each)
        expanded = (F.coalesce(p["units"], F.lit(1)) * each).cast("bigint")
        return F.struct((F.col("first") + i).cast("bigint").alias("n"), p["type"].alias("type"), p["ref"].alias("ref"), expanded.alias("tokens"))

    attached = F.transform(F.filter("parts", lambda p: _attached(p, kinds)), attachment)
    rows = rows.select("conv_id", F.struct("at", "turn_text", spans.alias("spans"), attached.alias("attached")).alias("turn"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    out = out.select(
        "conv_id",
        F.array_join("turns.turn_text", "").alias("formatted"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.flatten("turns.spans").alias("loss_spans"),
        F.flatten("turns.attached").alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def turns_read_back(formatted: Column) -> Column:
    """array<role, text> from a formatted conversation; placeholders stay as they are."""
    turns = F.slice(F.split(formatted, r"<\|end\|>", -1), F.lit(1), F.greatest(F.size(F.split(formatted, r"<\|end\|>", -1)) - 1, F.lit(0)))
    both = F.transform(turns, lambda t: F.split(F.substring(t, len(TURN) + 1, 2147483647), r"<\|text\|>", 2))
    return F.transform(both, lambda b: F.struct(unescaped(b[0]).alias("role"), unescaped(b[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["size"].cast("int")))), "")
