"""Global order without a one-task window: rows are dealt by ranges, and only one row a range meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.runtime import materialize


def dealt(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df written by ranges of order, with the number of a row's range as _range; ranges are in order and hold about as many
    rows each.  Written down, since the bounds are sampled and must be the same for all who read them."""
    return materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)


def running_starts(rows: DataFrame, order: list[Column], copies: str) -> DataFrame:
    """rows (from dealt, by the same order) with start, the sum of copies over all rows before, in order."""
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = rows.groupBy("_range").agg(F.sum(copies).alias("_own")).select("_range", F.coalesce(F.sum("_own").over(across), F.lit(0)).alias("_offset"))
    placed = rows.withColumn("_before", F.coalesce(F.sum(copies).over(within), F.lit(0)))
    return placed.join(offsets, "_range").withColumn("start", (F.col("_before") + F.col("_offset")).cast("bigint")).drop("_before", "_offset", "_range")


def following(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """rows (from dealt, by keys ascending; keys are unique and not null) with next_<c> for each c of keys and carried: the
    values of the next row in order, after the last those of the first."""
    own = F.struct(*[F.col(c) for c in keys + carried])
    within = Window.partitionBy("_range").orderBy(*keys)
    across = Window.orderBy("_range")  # a row for each range
    firsts = rows.groupBy("_range").agg(F.min(own).alias("_first"))
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_range", F.coalesce(F.lead("_first").over(across), F.first("_first").over(whole)).alias("_after"))
    out = rows.withColumn("_next", F.lead(own).over(within)).join(firsts, "_range")
    out = out.withColumn("_next", F.coalesce("_next", "_after"))
    return out.select(*keys, *carried, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in keys + carried])
