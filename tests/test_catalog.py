"""Every registered query against its SQL twin; those without one must run and give rows of a stable schema."""

import glob
import math
import os

import duckdb
import pytest

from lattica import catalog_more as catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def key(row):
    return tuple((v is None, not isinstance(v, int | float), v if isinstance(v, int | float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=key)
    if name not in catalog.ORACLES:
        assert cols
        return
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want
