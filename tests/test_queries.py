"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lumenweave import composites, queries, served  # noqa: F401  (all register queries)
from lumenweave.templates import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{FOLDER}/{n}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, db, name):
    got = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(*columns).collect())
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    assert rows
