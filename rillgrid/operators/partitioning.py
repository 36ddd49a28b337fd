"""Balanced partitions of sequences by length, for one batch at a time."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """In the given order, each to the partition of the smallest sum, the first of equals."""
    if len(lengths) < k or (equal_size and len(lengths) % k):
        raise ValueError(f"{len(lengths)} sequences don't fill {k} partitions")
    # with equal sizes, the fewest members come before the smallest sum
    heap = [(0, 0, p) for p in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        size, total, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (size + 1 if equal_size else 0, total + n, p))
    return parts


def karmarkar_karp(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: the two states of the widest spread are merged, largest sums with smallest, until one is left."""
    if len(lengths) < k or (equal_size and len(lengths) % k):
        raise ValueError(f"{len(lengths)} sequences don't fill {k} partitions")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    states = []
    size = k if equal_size else 1
    for at in range(0, len(order), size):
        sets = [(lengths[i], [i]) for i in order[at : at + size]] + [(0, [])] * (k - size)
        sets.sort(key=lambda s: (-s[0], -len(s[1]), s[1]))
        states.append(sets)
    heap = [(s[-1][0] - s[0][0], n, s) for n, s in enumerate(states)]
    heapq.heapify(heap)
    n = len(states)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        sets = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]
        sets.sort(key=lambda s: (-s[0], -len(s[1]), s[1]))
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], n, sets))
        n += 1
    return [sorted(s[1]) for s in heap[0][2]]


def ceildiv(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, b: int) -> int:
    """The smallest multiple of b that is at least a."""
    return ceildiv(a, b) * b


def inverse(order: list[int]) -> list[int]:
    """Where each place of a permutation went: inverse(order)[order[i]] is i."""
    out = [0] * len(order)
    for i, j in enumerate(order):
        out[j] = i
    return out


def checked(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Balanced parts that hold each index once, none empty and, if equal_size, all of one size."""
    parts = karmarkar_karp(lengths, k, equal_size)
    if len(parts) != k or not all(parts) or sorted(i for p in parts for i in p) != list(range(len(lengths))):
        raise ValueError("the parts don't hold every sequence once")
    if equal_size and len({len(p) for p in parts}) > 1:
        raise ValueError("the parts differ in size")
    return parts


def micro_batches(lengths: list[int], budget: int, at_least: int = 1, multiple_of: int = 1) -> list[list[int]]:
    """Balanced parts, as many as the total fills budgets, within the number of sequences.

    at_least and multiple_of raise the number, for ranks that have to agree on it.
    """
    if max(lengths) > budget:
        raise ValueError("a sequence is longer than the budget")
    k = min(len(lengths), ceildiv(sum(lengths), budget))
    return checked(lengths, min(len(lengths), round_up(max(k, at_least), multiple_of)))


def balance(df: DataFrame, batch: str, order: str, length: str, k: int, method: str = "karmarkar_karp", equal_size: bool = False) -> DataFrame:
    """(batch, order, partition) for the rows of each batch; batches are independent and go to tasks by their key."""
    how = {"karmarkar_karp": karmarkar_karp, "greedy": greedy}[method]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o")
        out = rows[["b", "o"]].assign(partition=0)
        for p, members in enumerate(how(rows["n"].tolist(), k, equal_size)):
            out.iloc[members, 2] = p
        return out.rename(columns={"b": batch, "o": order})

    slim = df.select(F.col(batch).cast("long").alias("b"), F.col(order).cast("long").alias("o"), F.col(length).cast("long").alias("n"))
    return slim.groupBy("b").applyInPandas(one, f"{batch} long, {order} long, partition long")
