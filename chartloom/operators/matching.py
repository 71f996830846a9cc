"""One-to-one assignment of scored pairs, the best first: groups that share no end are folded apart, each in one sorted scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.operators.lineage import cut_lineage, ship


def folded(pairs: DataFrame, group: Sequence[str], left: Sequence[str], right: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The pairs that a scan in order keeps: those whose ends, by the columns left and right, no kept pair of the group has.

    A group's pairs pass through one task in order; what is held is its used ends, so that the work is in proportion to the
    pairs.  Pairs of different groups must share no end.
    """
    ship(pairs.sparkSession)
    group, left, right = list(group), list(left), list(right)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        used: tuple[set, set] = (set(), set())
        for b in batches:
            each = [list(zip(*(b.column(c).to_pylist() for c in side), strict=True)) for side in (group, left, right)]
            keep = []
            for key, p, g in zip(*each, strict=True):
                if key != now:
                    now, used = key, (set(), set())
                free = p not in used[0] and g not in used[1]
                if free:
                    used[0].add(p)
                    used[1].add(g)
                keep.append(free)
            yield b.filter(pa.array(keep, pa.bool_()))

    return pairs.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(scan, pairs.schema)


def with_component(pairs: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """pairs with component bigint: pairs that share an end, directly or over others, have one component.

    Ends are known by a hash; two of one hash would only join two components.  In each pass a node hooks to its smallest
    neighbour, hooks are followed twice, and edges are drawn anew between what is left; as hashes are in no order along a
    chain, passes grow with the logarithm of its length.
    """
    node = lambda side, columns: F.xxhash64(F.lit(side), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    held = cut_lineage(pairs.withColumn("_a", node("left", left)).withColumn("_b", node("right", right)))
    edges = cut_lineage(held.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        for _ in range(2):
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
            hooks = hooks.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
        hooks = cut_lineage(hooks)
        moved = lambda df, c, hooks=hooks: df.join(hooks.select(F.col("node").alias(c), "parent"), c, "left").withColumn(c, F.coalesce("parent", c)).drop("parent")
        labels = cut_lineage(moved(labels, "component"))
        ends = moved(moved(edges, "a"), "b").where("a <> b")
        edges = cut_lineage(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return held.join(labels.withColumnRenamed("node", "_a"), "_a").drop("_a", "_b")
