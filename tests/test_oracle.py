"""Every query of the core against its SQL on the smallest tables."""

import glob
import os

import pytest

from quarry.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def test_every_query_has_sql_and_a_docstring_or_name():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, con, name):
    df = catalog.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    r = con.execute(catalog.oracle_sql()[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    assert got == sorted(tuple(norm(x[at.index(c)]) for c in cols) for x in r.fetchall())
