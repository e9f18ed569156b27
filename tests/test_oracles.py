"""Every query with a SQL counterpart against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpuslens.plans import queries as Q

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = Q.queries(), Q.oracle_sql()


def norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else None if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted((tuple(norm(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=str)
    assert sorted(columns) == names and got and got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
