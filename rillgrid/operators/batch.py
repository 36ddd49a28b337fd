"""Ordered batches: a DataFrame with a position column and metadata, and its row and column operations.

Row order is part of the model, so it is a column, `_pos`.  All operations are lazy and return new
batches.  A length is needed by few of them and is then counted once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

POS = "_pos"


def number_rows(df: DataFrame, *order: str, name: str = POS, start: int = 0) -> DataFrame:
    """df with consecutive numbers in the given order, without gathering all rows in one task.

    Rows are dealt by ranges and sorted, and each carries its range and its place in it; that is
    evaluated once and stored, as another evaluation could draw other ranges.  A range's rows are
    shifted by the sizes of the ranges before it, which are as few as partitions.
    """
    keys = [F.col(c) for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_nr_place", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("_nr_part", F.shiftright("_nr_place", 33)).withColumn("_nr_place", F.col("_nr_place").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = ranged.groupBy("_nr_part").agg((F.max("_nr_place") + 1).alias("_nr_n"))
    before = Window.orderBy("_nr_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_nr_part", F.coalesce(F.sum("_nr_n").over(before), F.lit(0)).alias("_nr_before"))
    return ranged.join(shift, "_nr_part").withColumn(name, (F.col("_nr_before") + F.col("_nr_place") + start).cast("long")).drop("_nr_part", "_nr_before", "_nr_place")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the given order, for an n that may grow with the data: no task holds them all."""
    return number_rows(df, *order, name="_first").filter(F.col("_first") < n).drop("_first")


@dataclass(frozen=True)
class Batch:
    """Columns with an order (`_pos`, from 0, without gaps) and metadata that holds for the whole."""

    df: DataFrame
    meta: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, *order: str, meta: dict | None = None) -> Batch:
        return cls(number_rows(df, *order), dict(meta or {}))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != POS]

    def __len__(self) -> int:
        return self.df.count()

    def _with(self, df: DataFrame, **meta) -> Batch:
        return Batch(df, {**self.meta, **meta})

    # columns

    def select(self, columns: list[str] | None = None, meta: list[str] | None = None) -> Batch:
        keep = self.columns if columns is None else columns
        self._known(keep)
        return Batch(self.df.select(POS, *keep), self.meta if meta is None else {k: self.meta[k] for k in meta})

    def pop(self, columns: list[str], meta: list[str] | None = None) -> tuple[Batch, Batch]:
        """(a batch of these columns, a batch of the others); an unknown one is an error."""
        self._known(columns)
        taken = {k: self.meta[k] for k in meta or []}
        return Batch(self.df.select(POS, *columns), taken), Batch(self.df.drop(*columns), {k: v for k, v in self.meta.items() if k not in taken})

    def rename(self, old: list[str] | str, new: list[str] | str) -> Batch:
        old, new = ([x] if isinstance(x, str) else list(x) for x in (old, new))
        if len(old) != len(new):
            raise ValueError(f"{len(old)} columns for {len(new)} names")
        self._known(old)
        return self._with(self.df.withColumnsRenamed(dict(zip(old, new, strict=True))))

    def union(self, other: Batch) -> Batch:
        """Columns of both, row by row; shared columns and metadata must be equal (NaN equals NaN)."""
        for k in self.meta.keys() & other.meta.keys():
            if self.meta[k] != other.meta[k]:
                raise ValueError(f"metadata {k} differs")
        shared = [c for c in other.columns if c in self.columns]
        right = other.df.select(F.col(POS).alias("_rpos"), *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in other.columns])
        both = self.df.join(right, F.col(POS) == F.col("_rpos"), "full_outer")
        same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_r_{c}")), shared, F.col(POS).isNotNull() & F.col("_rpos").isNotNull())
        if not both.filter(~same).isEmpty():
            raise ValueError("batches differ in length or in a shared column")
        return Batch(both.drop("_rpos", *[f"_r_{c}" for c in shared]), {**self.meta, **other.meta})

    # rows

    def slice(self, start: int = 0, stop: int | None = None, step: int = 1) -> Batch:
        at = F.col(POS) - start
        keep = (at >= 0) & (at % step == 0) & (F.lit(True) if stop is None else F.col(POS) < stop)
        return self._with(self.df.filter(keep).withColumn(POS, F.floor(at / step).cast("long")))

    def reorder(self, index: list[int]) -> Batch:
        """Row index[i] comes to place i; rows may repeat or be left out, and a mask of booleans picks rows."""
        if index and isinstance(index[0], bool):
            index = [i for i, kept in enumerate(index) if kept]
        spark = self.df.sparkSession
        n = len(self)
        place = spark.createDataFrame([(i, j if j >= 0 else n + j) for i, j in enumerate(index)], "_to long, _from long")
        return self._with(self.df.join(F.broadcast(place), F.col(POS) == F.col("_from")).drop(POS, "_from").withColumnRenamed("_to", POS))

    def __getitem__(self, item) -> Batch | dict:
        """A slice, a list of places or booleans, or the row at one place as a dict."""
        if isinstance(item, slice):
            n = len(self) if any(x is not None and x < 0 for x in (item.start, item.stop)) else 0
            start, stop = ((x + n if x is not None and x < 0 else x) for x in (item.start, item.stop))
            return self.slice(start or 0, stop, item.step or 1)
        if isinstance(item, list):
            return self.reorder(item)
        row = self.df.filter(F.col(POS) == (item if item >= 0 else len(self) + item)).first()
        if row is None:
            raise IndexError(item)
        return {k: v for k, v in row.asDict(True).items() if k != POS}

    def save(self, path: str) -> None:
        """The rows as Parquet, and the metadata beside them as JSON."""
        self.df.write.mode("overwrite").parquet(f"{path}/rows")
        self.df.sparkSession.createDataFrame([(json.dumps(self.meta),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> Batch:
        return cls(spark.read.parquet(f"{path}/rows"), json.loads(spark.read.json(f"{path}/meta").first()[0]))

    def rank(self, world: int) -> Batch:
        """A column `_rank`: neighbouring rows go to the same of `world` ranks, as chunk deals them."""
        n = len(self)
        if n % world:
            raise ValueError(f"{n} rows can't be dealt to {world} ranks")
        return self._with(self.df.withColumn("_rank", F.floor(F.col(POS) / max(1, n // world)).cast("int")))

    def where(self, condition) -> Batch:
        return self._with(number_rows(self.df.filter(condition).withColumnRenamed(POS, "_old"), "_old").drop("_old"))

    def chunk(self, chunks: int, uneven: bool = False) -> list[Batch]:
        """Equal parts in order; the length must be a multiple of their number, unless they may be uneven.

        Uneven parts have the size rounded up, so that the last one is shorter and there may be fewer of them.
        """
        n = len(self)
        if n % chunks and not uneven:
            raise ValueError(f"{n} rows can't be cut into {chunks} equal parts")
        size = max(1, -(-n // chunks))
        return [self.slice(a, min(a + size, n)) for a in range(0, n, size)]

    def map_batches(self, size: int, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: list[str] | None = None) -> Batch:
        """function of each run of `size` rows, with only the columns it needs; rows keep their places."""
        keep = self.columns if columns is None else columns

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(POS)
            return function(part[keep]).assign(**{POS: part[POS].to_numpy()})

        rows = self.df.select(POS, *keep).withColumn("_b", F.floor(F.col(POS) / size))
        return self._with(rows.groupBy("_b").applyInPandas(run, f"{schema}, {POS} long"))

    def nested_batches(self, mini: int, micro: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
        """Rows with epoch, mini-batch and, within that, micro-batch numbers."""
        if mini % micro:
            raise ValueError(f"mini-batches of {mini} can't be cut into {micro}")
        rows = self.batches(mini, epochs, seed, drop_last=True)
        within = F.row_number().over(Window.partitionBy("epoch", "batch").orderBy(POS)) - 1
        return rows.withColumn("micro", F.floor(within / micro).cast("long"))

    def balanced(self, length: str, ranks: int) -> Batch:
        """Rows in the order of ranks, of equal numbers and like token totals; the lengths pass through the driver, a number a row of one batch."""
        from .partitioning import karmarkar_karp

        lengths = [r[0] for r in self.df.orderBy(POS).select(length).collect()]
        return self.reorder([i for part in karmarkar_karp(lengths, ranks, True) for i in part])

    def split(self, size: int) -> list[Batch]:
        return [self.slice(a, a + size) for a in range(0, len(self), size)]

    @staticmethod
    def concat(batches: list[Batch]) -> Batch:
        """All rows in order; columns must be the same, and the first batch's metadata holds."""
        frames, shift = [], 0
        for b in batches:
            frames.append(b.df.withColumn(POS, F.col(POS) + shift))
            shift += len(b)
        return Batch(reduce(DataFrame.unionByName, frames), dict(batches[0].meta))

    def repeat(self, times: int, interleave: bool = True) -> Batch:
        """Each row `times` times, one after another or the whole batch again."""
        n = 0 if interleave else len(self)
        place = F.col(POS) * times + F.col("_k") if interleave else F.col("_k") * n + F.col(POS)
        return self._with(self.df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(POS, place.cast("long")).drop("_k"))

    def sample_level_repeat(self, times: str) -> Batch:
        """Each row as often as its column `times` says."""
        more = self.df.filter(F.col(times) > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
        return self._with(number_rows(more.withColumnRenamed(POS, "_old"), "_old", "_k").drop("_old", "_k"))

    def pad_to_divisor(self, divisor: int) -> tuple[Batch, int]:
        """Rows from the start again and again until the length is a multiple; and how many."""
        n = len(self)
        pad = -n % divisor if n else 0
        if not pad:
            return self, 0
        again = self.repeat(1 + -(-pad // n), interleave=False)
        return again.slice(0, n + pad), pad

    def padding(self, size: int, candidate: str = "") -> Batch:
        """`size` copies of the first row, or of the last unless candidate is "first", after all others."""
        n = len(self)
        edge = self.df.filter(F.col(POS) == (0 if candidate == "first" else n - 1))
        more = edge.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn(POS, (F.lit(n) + F.col("_k")).cast("long")).drop("_k")
        return self._with(self.df.unionByName(more)) if size else self

    def scatter(self, workers: int) -> tuple[list[Batch], int]:
        """Equal parts for all workers, padded from the front if need be, and how many rows the padding has."""
        padded, pad = self.pad_to_divisor(workers)
        return padded.chunk(workers), pad

    @staticmethod
    def gather(parts: list[Batch], pad: int = 0) -> Batch:
        """The parts in order, without the padding."""
        return Batch.concat(parts).unpad(pad)

    def sizes_gb(self) -> dict[str, float]:
        """Gigabytes of each column's values as text or plain binary form."""
        width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
        one = [F.sum(F.lit(width[t]) if t in width else F.lit(8) if t in ("bigint", "double", "timestamp") else F.octet_length(F.to_json(F.struct(c)))).alias(c) for c, t in self.df.select(self.columns).dtypes]
        return {c: (v or 0) / 1e9 for c, v in self.df.agg(*one).first().asDict().items()}

    def unpad(self, pad: int) -> Batch:
        return self.slice(0, len(self) - pad) if pad else self

    def fold(self, groups: int) -> Batch:
        """`groups` rows, each with arrays of the rows that follow one another."""
        n = len(self)
        if n % groups:
            raise ValueError(f"{n} rows can't be folded into {groups}")
        size = n // groups
        row = F.array_sort(F.collect_list(F.struct(POS, *self.columns)))
        folded = self.df.groupBy(F.floor(F.col(POS) / size).cast("long").alias("_g")).agg(row.alias("_r"))
        return self._with(folded.select(F.col("_g").alias(POS), *[F.col(f"_r.{c}").alias(c) for c in self.columns]))

    def unfold(self) -> Batch:
        """The inverse of fold: all columns are arrays of one length."""
        one = self.df.select(POS, F.posexplode(F.arrays_zip(*self.columns)).alias("_i", "_r"), F.size(self.columns[0]).alias("_n"))
        return self._with(one.select((F.col(POS) * F.col("_n") + F.col("_i")).cast("long").alias(POS), *[F.col(f"_r.{c}").alias(c) for c in self.columns]))

    def unfold_column_chunks(self, n: int, columns: list[str]) -> Batch:
        """Arrays in `columns` are cut into n equal parts, a row each; the other columns repeat."""
        k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cut = lambda c: F.slice(c, (F.col("_k") * (F.size(c) / n)).cast("int") + 1, (F.size(c) / n).cast("int")).alias(c)
        return self._with(self.df.withColumn("_k", k).select((F.col(POS) * n + F.col("_k")).cast("long").alias(POS), *[cut(c) if c in columns else F.col(c) for c in self.columns]))

    def batches(self, size: int, epochs: int = 1, seed: int | None = None, drop_last: bool = False) -> DataFrame:
        """Rows with epoch and batch numbers; the order of each epoch follows from the seed."""
        n = len(self)
        if n % size and not drop_last and seed is None:
            raise ValueError(f"{n} rows can't be cut into batches of {size}")
        rows = self.df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        order = [F.col(POS)] if seed is None else [F.md5(F.concat_ws(":", F.lit(seed), "epoch", POS)), F.col(POS)]
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("epoch").orderBy(*order)) - 1).withColumn("batch", F.floor(F.col("_rn") / size).cast("long"))
        return (rows.filter(F.col("batch") < n // size) if drop_last else rows).drop("_rn")

    def check(self) -> None:
        """An error unless positions are 0 to n - 1."""
        n, low, high, kinds = self.df.agg(F.count("*"), F.min(POS), F.max(POS), F.count_distinct(POS)).first()
        if n and (low, high, kinds) != (0, n - 1, n):
            raise ValueError("positions have gaps or repeat")

    def collect(self) -> list[dict]:
        return [{k: v for k, v in r.asDict(True).items() if k != POS} for r in self.df.orderBy(POS).collect()]

    def _known(self, columns: list[str]) -> None:
        if unknown := [c for c in columns if c not in self.columns]:
            raise KeyError(f"no columns {unknown}")
