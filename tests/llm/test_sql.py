"""Queries with SQL return DuckDB's rows, and all dealt operators are registered."""

import os
import re

import duckdb
import pytest

import __spark_entry__
from rillgrid.llm import registry

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = {int(m[1]) for m in (re.match(r"op(\d+)_", q) for q in __spark_entry__.queries()) if m}
    assert names == set(range(1, 11)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", list(registry.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = db.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall())
