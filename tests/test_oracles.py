"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from gridlark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(None if x is None or x != x else x for x in r) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False)), key=repr)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=2e-6, rel_tol=1e-6))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, db, name):
    got, want = rows(catalogue.QUERIES[name](spark, SF).toPandas()), rows(db.execute(catalogue.ORACLES[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert all(same(x, y) for a, b in zip(got[1], want[1], strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
