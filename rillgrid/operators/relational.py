"""Set operations, grouping sets and quantiles that users of tables expect beside the batch operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_keys(df: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is among those kept."""
    return df.join(kept.select(*keys).distinct(), keys, "left_semi")


def without_keys(df: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those dropped."""
    return df.join(dropped.select(*keys), keys, "left_anti")


def distinct_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Different keys of a that b lacks."""
    return without_keys(a.select(*keys).distinct(), b, keys)


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows by column names; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def cube(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates of all combinations of keys, with `g`, the bits of the keys that are left out."""
    return df.cube(*keys).agg(*[c.alias(k) for k, c in aggregates.items()], F.grouping_id().cast("long").alias("g"))


def quantiles(df: DataFrame, group: list[str], value: str, **shares: float) -> DataFrame:
    """Exact quantiles of each group, by interpolation."""
    return df.groupBy(*group).agg(*[F.percentile(value, share).alias(name) for name, share in shares.items()])


def approximate_quantiles(df: DataFrame, group: list[str], value: str, accuracy: int = 10_000, **shares: float) -> DataFrame:
    """The same from sketches, which are small whatever the group."""
    return df.groupBy(*group).agg(*[F.percentile_approx(value, share, accuracy).alias(name) for name, share in shares.items()])


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], kind: str, value: str) -> DataFrame:
    """A row for each of the columns."""
    return df.unpivot(keys, columns, kind, value)
