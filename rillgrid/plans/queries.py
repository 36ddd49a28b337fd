"""The register of queries: each by its function's name, with its SQL for DuckDB where SQL can express it.

Floats are rounded on both sides; every ranking has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "eval_accuracy_rollup"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    # + 0.0 makes a negative zero positive
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def scaled6(c: Column | str) -> Column:
    """Six digits as DuckDB rounds a double: its product with 10**6, half away from zero, over 10**6.

    Spark's round takes the shortest decimal instead; they part where the value is within an ulp or so of a tie.
    """
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(1e6), 0) / F.lit(1e6) + F.lit(0.0)
