"""Every query with oracle SQL gives DuckDB's rows; every query yields a stable schema."""

import decimal
import glob
import os

import duckdb
import pytest

from veilframe.plans.queries import ORACLE, QUERIES


def shown(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6))
    return repr(v) if v is None or isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    if name in ORACLE:
        found = duck.sql(ORACLE[name])
        at = [found.columns.index(c) for c in names]
        assert sorted(found.columns) == names
        assert got == sorted(tuple(shown(r[k]) for k in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
