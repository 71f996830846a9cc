"""Connected components over an edge table, by repeated hooking and contraction.

Each round hooks every node to its smallest neighbour when that is smaller, follows the hooks twice, and replaces the
edges by the edges between the hooked nodes; edges inside one tree disappear.  The edge table shrinks round by round and
never leaves the executors.  Every round's tables are written to shared storage, so a lost executor repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.runtime import materialize


_ROWS_A_FILE = 500_000  # a round's tables are written in as many files as the edges need, not one for each shuffle partition


def _followed(hooks: DataFrame) -> DataFrame:
    """Two pointer jumps: (node, parent) with parent replaced by its own parent where it has one."""
    for _ in range(2):
        up = hooks.select(F.col("node").alias("via"), F.col("parent").alias("top"))
        hooks = hooks.join(up, hooks["parent"] == up["via"], "left").select("node", F.coalesce("top", "parent").alias("parent"))
    return hooks


def _moved(table: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """table with `column` replaced by its parent, where it has one."""
    others = [c for c in table.columns if c != column]
    up = hooks.select(F.col("node").alias("moved_from"), F.col("parent").alias("moved_to"))
    return table.join(up, table[column] == up["moved_from"], "left").select(*others, F.coalesce("moved_to", column).alias(column))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) bigint edges -> (node, component), component being the smallest node reachable.

    Nodes without an edge to another node are not in the result.  Self loops and repeated edges are allowed; an edge with
    a null end is ignored; an empty table gives an empty result.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    parts = max(1, -(-edges.count() // _ROWS_A_FILE))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("component")).coalesce(parts), "cc-labels")
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        hooks = materialize(both.groupBy("node").agg(F.min("other").alias("parent")).coalesce(parts), "cc-hooks")
        hooks = materialize(_followed(hooks).coalesce(parts), "cc-jumped")
        labels = materialize(_moved(labels, "component", hooks).coalesce(parts), "cc-labels")
        moved = _moved(_moved(edges, "a", hooks), "b", hooks).where("a <> b")
        edges = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(parts), "cc-edges")
    return labels
