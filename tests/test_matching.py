import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import evaluation as E
from chartloom.operators import matching as M

KIND = "p_source bigint, p_idx bigint, g_source bigint, g_idx bigint, entity_type string, score double, exact boolean"


def greedy(rows):
    used, out = set(), []
    first = lambda x: (x is not None, x or 0)
    for r in sorted(rows, key=lambda r: (-r[5], first(r[0]), r[1], first(r[2]), r[3])):
        ends = (("p", r[4], r[0], r[1]), ("g", r[4], r[2], r[3]))
        if used.isdisjoint(ends):
            used.update(ends)
            out.append(r)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_components_folded_alone_are_one_scan(spark, seed):
    rng = random.Random(seed)
    rows = {(rng.choice([None, 1, 2, 3]), rng.randint(0, 8), rng.choice([None, 1, 2, 3]), rng.randint(0, 8), rng.choice("ab")): (rng.choice([0.5, 0.6, 1.0]), True) for _ in range(150)}
    rows = [(*k, *v) for k, v in rows.items()]
    assert sorted(map(tuple, E.any_source_matches(spark.createDataFrame(rows, KIND)).collect()), key=repr) == greedy(rows)


def test_a_chain_of_ten_thousand_pairs_takes_few_passes(spark, monkeypatch):
    n = 10_000  # p0-g0, g0-p1, p1-g1, ...: scores fall along the chain, so that a scan keeps every second pair
    rows = [(None, (i + 1) // 2, 1, i // 2, "a", 1 - i / (2 * n), False) for i in range(n)]
    writes = []
    real = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: writes.append(1) or real(df))
    got = E.any_source_matches(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(map(tuple, got), key=repr) == greedy(rows) and len(got) == n // 2
    assert len(writes) <= 2 + 3 * 12


def test_a_large_group_is_folded_in_proportion_to_its_pairs(spark):
    n = 30_000
    pairs = spark.range(n).select(F.lit(1).cast("bigint").alias("source_id"), F.lit("a").alias("entity_type"), ((F.col("id") + 1) / 2).cast("bigint").alias("p_idx"), (F.col("id") / 2).cast("bigint").alias("g_idx"), (1 - F.col("id") / (2 * n)).alias("score"), F.lit(False).alias("exact"))
    assert E.greedy_matches(pairs).count() == n // 2
    assert E.greedy_matches(pairs.limit(0)).count() == 0 and E.any_source_matches(spark.createDataFrame([], KIND)).count() == 0


def test_components_are_those_of_shared_ends(spark):
    rows = [(1, 1, 1, 1, "a", 1.0, True), (1, 2, 1, 1, "a", 1.0, True), (1, 2, None, 5, "a", 1.0, True), (1, 1, 1, 1, "b", 1.0, True), (None, 9, 1, 7, "a", 1.0, True)]
    got = M.with_component(spark.createDataFrame(rows, KIND), ["entity_type", "p_source", "p_idx"], ["entity_type", "g_source", "g_idx"]).collect()
    of = {(r["p_source"], r["p_idx"], r["g_source"], r["g_idx"], r["entity_type"]): r["component"] for r in got}
    groups = {}
    for k, c in of.items():
        groups.setdefault(c, set()).add(k)
    assert sorted(map(len, groups.values())) == [1, 1, 3]
