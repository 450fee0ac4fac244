"""Every registered query that has SQL against DuckDB over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from cellweave.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v if v is None or isinstance(v, (str, bool)) else str(v)


def alike(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    assert all(alike(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
