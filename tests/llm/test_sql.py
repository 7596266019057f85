"""The operators that have SQL against it, in DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from netlens.llm import queries

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine = queries.queries()[name](spark, DATA)
    theirs = duck.sql(queries.oracle_sql()[name])
    assert {c: TYPES.get(k, k) for c, k in mine.dtypes} == dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    order = sorted(mine.columns)
    assert sorted(map(repr, map(tuple, mine.select(*order).collect()))) == sorted(map(repr, theirs.select(*order).fetchall()))
