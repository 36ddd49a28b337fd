"""Each query with SQL returns DuckDB's rows over the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from rillgrid.plans import catalogue, scores, training  # noqa: F401  all register their queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(df):
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 5) + 0.0 if isinstance(x, float) else str(x) if isinstance(x, pd.Timestamp) else x

    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.SQL:
        assert rows(got) == rows(db.execute(catalogue.SQL[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert catalogue.FLAGSHIP in __spark_entry__.queries()


def test_process_rewards_round_as_sql(spark):
    """Ties at the sixth digit, of which these scores have many, go as in SQL: one thread, as several add floats in an order of their own."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
    name, key = "process_reward_tokens", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    got = catalogue.QUERIES[name](spark, DATA).toPandas().sort_values(key).score.to_numpy()
    want = con.execute(catalogue.SQL[name]).fetchdf().sort_values(key).score.to_numpy()
    assert len(got) == len(want) and abs(got - want).max() < 1e-9
