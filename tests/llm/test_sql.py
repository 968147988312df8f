"""Corpus queries with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from gridlark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert Counter(map(tuple, got.select(names).collect())) == Counter(want[names].itertuples(index=False, name=None))
