"""Queries with SQL against it, on the smallest tables."""

import duckdb
import pytest

from lumenweave.llm import queries
from lumenweave.templates import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for n in TABLES:
        db.execute(f"create view {n} as select * from '{FOLDER}/{n}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
