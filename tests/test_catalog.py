"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from vectrill.plans import catalog  # noqa: E402


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([round(float(r[i]), 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    got = shown(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.oracle_sql():
        assert got[1]
        return
    want = tables.sql(catalog.oracle_sql()[name])
    assert got == shown(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
