"""The driver's contract: names, the flagship query, and SQL for every core query that has some, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tracewright.plans import catalog

SF = "/root/testdata/sf0.001"


def test_names():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and "p2_found" in q and "p3_found" in q


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity_ref", "predicate", "seq"] and df.count() > 0


def _norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    b = sorted(repr(tuple(_norm(r[i]) for i in at)) for r in want.fetchall())
    assert a == b
