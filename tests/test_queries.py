"""Every registered query of the ledger operators against its SQL, run by DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import queries as P

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is pd.NA or v is pd.NaT or v is None or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v


def rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(P.QUERIES))
def test_equals_sql(spark, duck, name):
    got = P.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(P.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module_reads():
    import __spark_entry__ as entry

    assert set(P.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
