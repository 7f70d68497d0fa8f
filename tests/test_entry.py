"""Every registered query on the smallest tables: equal to its SQL where it has any, else planned and counted.

The queries of the llm subpackage have a test of the same kind beside their own."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def compare(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF)
    rows = df.collect()
    if name not in e.oracle_sql():
        assert df.columns and len(rows) >= 0
        return
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS FROM '{SF}/{f}'")
    columns = sorted(df.columns)
    flat = lambda v: round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    want = c.sql(e.oracle_sql()[name])
    at = [want.columns.index(x) for x in columns]
    assert sorted(want.columns) == columns
    assert sorted(repr(tuple(flat(r[x]) for x in columns)) for r in rows) == sorted(repr(tuple(flat(r[i]) for i in at)) for r in want.fetchall())


def names(*modules):
    import importlib

    return [n for m in modules for n in importlib.import_module(m).QUERIES]


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", names("memloom.plans.core_queries", "memloom.plans.reference_queries", "memloom.plans.operator_queries"))
def test_queries_equal_sql(spark, name):
    compare(spark, name)
