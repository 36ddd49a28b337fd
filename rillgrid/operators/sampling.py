"""Seeded orders, splits and samples: the order is a hash of seed and key, the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import number_rows


def seeded(seed: object, *key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def split(df: DataFrame, seed: object, key: list[str], ratio: float) -> DataFrame:
    """df with `split`: the first int(n * ratio) rows of the seeded order are train, the others test.

    The boundary is found by number, not by sorting all rows in one task.
    """
    keyed = df.withColumn("_h", seeded(seed, *key))
    n = int(df.count() * ratio)
    return number_rows(keyed, "_h", *key, name="_rn").withColumn("split", F.when(F.col("_rn") < n, "train").otherwise("test")).drop("_h", "_rn")


def sample_per_group(df: DataFrame, group: list[str], n: int, seed: object, key: list[str]) -> DataFrame:
    """n rows of each group, those first in the seeded order."""
    w = Window.partitionBy(*group).orderBy(seeded(seed, *key), *key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def upsert(original: DataFrame, updated: DataFrame, key: str) -> DataFrame:
    """Rows of original, replaced by those of updated with their key."""
    return original.join(updated.select(key), key, "left_anti").unionByName(updated.select(*original.columns))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def first_samples(df: DataFrame, n: int, seed: object, key: list[str]) -> DataFrame:
    """n rows of a seeded order, the same ones for the same rows: what is shown of a validation."""
    return df.withColumn("_h", seeded(seed, *key)).orderBy("_h", *key).limit(n).drop("_h")


def continued(new: DataFrame, known: DataFrame, order: list[str], index: str = "index") -> DataFrame:
    """new with indexes that go on after known's largest."""
    start = known.agg(F.coalesce(F.max(F.col(index).cast("long")) + 1, F.lit(0))).first()[0]
    return number_rows(new, *order, name=index, start=int(start))


def rl_data(train: DataFrame, raw: DataFrame, prompt: Column, reward: Column, metadata: Column, ratio: float, seed: object) -> tuple[DataFrame, DataFrame]:
    """(train, test) records of the train rows that raw rows of their index stand behind, in a seeded split."""
    from rillgrid.sources.readers import rl_records

    rows = rl_records(train.join(raw, "index"), prompt, reward, metadata, "index")
    dealt = split(rows, seed, ["index"], ratio)
    return dealt.filter("split = 'train'").drop("split"), dealt.filter("split = 'test'").drop("split")
