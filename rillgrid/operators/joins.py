"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, order: str, columns: list[str]) -> DataFrame:
    """Each left row with `columns` of the right row that is latest at or before its time, null without one.

    Both sides go through one sort by key and time instead of a join of all pairs; of right rows
    of one time the largest `order` counts.
    """
    picked = F.struct(*columns)
    a = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_o"), F.lit(None).cast(right.select(picked.alias("x")).schema["x"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    b = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), picked.alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_l"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    return both.filter("_side = 1").select("_l.*", *[F.col(f"_hit.{c}").alias(f"asof_{c}") for c in columns])


def in_ranges(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges [low, high) that hold them: an equi-join on buckets of `width`, then the exact test."""
    bucket = lambda c: F.floor(c / width)
    spread = ranges.withColumn("_b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return points.withColumn("_b", bucket(F.col(value))).join(spread, "_b").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_b")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def salted_join(big: DataFrame, small: DataFrame, key: str, salt: Column, salts: int) -> DataFrame:
    """An inner join with each key of `big` dealt over `salts` tasks; small's rows go to all of them."""
    left = big.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")
