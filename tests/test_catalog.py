"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from chartloom.plans import adapters, catalog, documents, durable, review, wide  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "part events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if hasattr(v, "quantize") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    relation = duck.sql(catalog.SQL[name])
    assert sorted(relation.columns) == columns
    want = sorted(repr(tuple(plain(r[relation.columns.index(c)]) for c in columns)) for r in relation.fetchall())
    assert got == want
    assert got


def test_entry_module_has_the_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
