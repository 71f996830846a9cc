"""Tables that grow with the notes meet by sort and merge: Spark's own sizes take them for small ones."""

import pytest
from pyspark.sql import functions as F

from chartloom.operators import relations as N


@pytest.fixture
def exploded(spark, tmp_path):
    """One row of eight bytes a note, as Spark counts it, and 200 after the explode."""
    spark.range(2000).withColumnRenamed("id", "note_id").write.parquet(str(tmp_path / "n"))
    rows = spark.read.parquet(str(tmp_path / "n"))
    return lambda *columns: rows.select("note_id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("ord")).select("note_id", "ord", *columns)


def plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_nested_symptoms_are_not_broadcast(exploded):
    kind = F.when(F.col("ord") % 2 == 0, "problem").otherwise("symptom").alias("entity_type")
    spans = F.array(F.struct(F.col("ord").alias("start_char"), (F.col("ord") + 3 - F.col("ord") % 2 * 2).alias("end_char"))).alias("mentions")
    found = N.without_nested_symptoms(exploded(kind, F.lit("high").alias("confidence"), spans))
    assert "BroadcastHashJoin" not in plan(found)
    assert found.groupBy(kind).count().collect()[0]["count"] == 2000 * 100


def test_links_are_not_broadcast(exploded):
    odd = F.col("ord") % 2 == 1
    name, kind = F.when(odd, "type 2 diabetes mellitus").otherwise("metformin").alias("canonical_name"), F.when(odd, "problem").otherwise("plan").alias("entity_type")
    start = F.col("ord") * 1000
    rows = exploded(name, kind, F.lit("present").alias("assertion"), F.lit(None).cast("string").alias("body_site"), start.alias("start_char"), F.array(start).alias("starts"), F.array(F.lit("s")).alias("sentences"))
    made = plan(N.relations(rows))
    assert "BroadcastHashJoin [note_id" not in made and "BuildLeft" not in made


def test_notes_are_dealt_by_their_number(spark, monkeypatch):
    from chartloom.sources import notes

    monkeypatch.setattr(notes, "NOTES_A_TASK", 100)
    assert notes.spread(spark.range(1001).repartition(1)).rdd.getNumPartitions() == 11
    assert notes.spread(spark.range(5).repartition(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_set_queries_have_no_join(spark):
    from chartloom.plans.wide import W  # noqa: F401  (registers its queries)
    from chartloom.plans.catalog import QUERIES

    for name in ("set_found_by_both", "set_missed_by_families"):
        made = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "(note_id" not in "".join(x for x in made.splitlines() if "Join" in x), name


@pytest.mark.parametrize("common", [0, 2, 100])
def test_a_common_filter_is_searched_once(spark, monkeypatch, common):
    from chartloom.operators import adapters
    from chartloom.operators.adapters import search_codes

    monkeypatch.setattr(adapters, "COMMON", common)

    codes = spark.createDataFrame([("heart rate", "L", "1", "a"), ("heart", "L", "2", "b"), ("pain", "L", "3", "c")], "name string, system string, code string, display string")
    queries = spark.createDataFrame([(1, "HEART"), (2, "heart"), (3, "3"), (4, "none"), (5, None), (6, "pain"), (6, "heart"), (7, "heart"), (7, "heart")], "query_id int, filter string")
    found = search_codes(codes, queries, 2)
    hits = [(1, "2"), (1, "1"), (2, "2"), (2, "1"), (3, "3"), (6, "2"), (6, "1"), (7, "2"), (7, "1")]
    assert [(r.query_id, r.code) for r in found.orderBy("query_id", "rank").collect()] == hits
    assert "windowspecdefinition(query_id" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_features_join_no_attributes(spark):
    from chartloom.operators.features import feature_matrix

    day = lambda n: F.to_timestamp(F.lit(f"2024-01-0{n}"))
    note = spark.range(1)
    records = note.select(F.lit(1).alias("patient_id"), day(1).alias("observed_at"), F.struct(F.lit(1)).alias("ord"), F.lit("vital").alias("entity_type"), F.lit("Heart rate").alias("normalized_text"), F.lit("x").alias("text"), F.lit("present").alias("assertion"), F.create_map(F.lit("value"), F.lit("72")).alias("attributes"))
    out = feature_matrix(records, note.select(F.lit(1).alias("patient_id"), F.lit(9).alias("visit_id"), day(2).alias("prediction_time")))
    row = out.collect()[0]
    assert (row.heart_rate__last, row.heart_rate__present_count, row.phq9__missing) == (72.0, 1, True)
    joined = out._jdf.queryExecution().analyzed().toString()
    assert "attributes" not in joined[: joined.index("Join")]
