"""Benchmark decontamination by greedy string tiling.

Tokens are words of letters, digits and non-ASCII characters, with A to Z in lower case.  A
benchmark item and a document meet by shared seeds, runs of `least` tokens with equal rolling
(Karp-Rabin) hashes.  For each such pair, if the seeds alone can reach the threshold, the longest
match is marked again and again, ties by the item's and then the document's place; what overlaps
a marked part is cut back to what is free, and counts while it has `least` tokens.  coverage is
the marked share of the item's tokens, wherever in the document they stand and in any order.

The benchmark is the stated query set and goes against all documents in blocks of at most
`block_mb` of text; its size is summed before any of it is sent.  Documents pass from block to
block within a task, so they are read once and never shuffled; `at_once` blocks are sent at a time, and
a benchmark of more of them has its documents' findings written in between.

Cases: null or empty texts on either side match nothing; an item of fewer than `least` tokens is
matched as a whole; repeated documents and items are compared like others, and rows without a doc_id too; empty tables give no
matches; columns other than doc_id and text, item_id and text are ignored, and kept by clean().
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import bounded_batches, stage


class Items:
    """A block of the benchmark: token hashes of each item, and all seeds sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        buf, offs = tx.buffers(pa.array(texts, pa.string()))
        starts, ends, firsts = tx.words(tx.LOWER[buf], offs, tx.NOT_ALNUM)
        self.ids, self.least, self.firsts = ids, least, firsts
        self.tokens = tx.hash_spans(buf, starts, ends, tx.LOWER)
        n = np.diff(firsts)
        seeds, at, size = [], [], []
        for length in {least, *n[(n > 0) & (n < least)].tolist()}:
            g = tx.rolling(self.tokens, length, 6)
            own = tx.owners(firsts)
            ok = np.flatnonzero((own[: len(g)] == own[length - 1 :][: len(g)]) & ((n[own[: len(g)]] == length) if length < least else True))
            seeds.append(g[ok])
            at.append(ok)
            size.append(np.full(len(ok), length))
        seeds, self.at, self.size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, at, size))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at, self.size = seeds[order], self.at[order], self.size[order]
        self.item = np.searchsorted(firsts, self.at, "right") - 1
        self.lengths = sorted(set(self.size.tolist()))


def tile(matches: list[tuple[int, int, int]], n_item: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of maximal matches (length, item place, document place)."""
    mine, theirs, tiles = np.zeros(n_item, bool), set(), []
    heap = [(-n, i, d) for n, i, d in matches]
    heapq.heapify(heap)
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [not mine[i + k] and d + k not in theirs for k in range(-n)]
        if all(free):
            mine[i : i - n] = True
            theirs.update(range(d, d - n))
            tiles.append((-n, i, d))
            continue
        k = 0
        while k < -n:
            e = k
            while e < -n and free[e]:
                e += 1
            if e - k >= least:
                heapq.heappush(heap, (k - e, i + k, d + k))
            k = max(e, k + 1)
    return tiles


def compare(part: pa.RecordBatch, items: Items, threshold: float, most: int = 1 << 22) -> Iterator[tuple[int, int, int]]:
    """(row, item, tokens covered) of all pairs that reach the threshold.

    Seeds that stand often on both sides make many pairs of places: `most` are held at a time, or
    those of one document.
    """
    buf, offs = tx.buffers(part.column("text"))
    buf = tx.LOWER[buf]
    starts, ends, firsts = tx.words(buf, offs, tx.NOT_ALNUM)
    h, own = tx.hash_spans(buf, starts, ends), tx.owners(firsts)
    hits = []
    for length in items.lengths:
        g = tx.rolling(h, length, 6)
        ok = own[: len(g)] == own[length - 1 :][: len(g)]
        low, high = np.searchsorted(items.seeds, g, "left"), np.searchsorted(items.seeds, g, "right")
        at = np.flatnonzero((high > low) & ok)
        hits.append((at, low[at], (high - low)[at], np.full(len(at), length)))
    at, low, n, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 4
    by = np.argsort(at, kind="stable")
    at, low, n, length = at[by], low[by], n[by], length[by]
    # so many pairs of places at a time, whole documents
    ends = np.searchsorted(at, firsts[1:])
    total = np.concatenate([[0], np.cumsum(n)])[ends]
    begin = done = 0
    while begin < len(at):
        k = max(int(np.searchsorted(total, done + most, "right")) - 1, int(np.searchsorted(ends, begin, "right")))
        part_ = slice(begin, int(ends[k]))
        yield from _compared(at[part_], low[part_], n[part_], length[part_], own, items, threshold)
        begin, done = int(ends[k]), int(total[k])


def _compared(hit: np.ndarray, low: np.ndarray, n: np.ndarray, length: np.ndarray, own: np.ndarray, items: Items, threshold: float) -> Iterator[tuple[int, int, int]]:
    """The same, from the documents' places that have seeds: how many, from where in the index, and of what length."""
    seed = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = np.repeat(hit, n)
    fit = items.size[seed] == np.repeat(length, n)
    at, seed = at[fit], seed[fit]
    if not len(at):
        return
    doc, item = own[at], items.item[seed]
    place, size = items.at[seed] - items.firsts[item], items.size[seed]
    order = np.lexsort((at, at - place, item, doc))
    at, doc, item, place, size = at[order], doc[order], item[order], place[order], size[order]
    pair = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(pair.tolist(), [*pair[1:].tolist(), len(at)], strict=True):
        n_item = int(items.firsts[item[a] + 1] - items.firsts[item[a]])
        # no tiling covers more than the seeds do
        if tx.cover(n_item, place[a:b], place[a:b] + size[a:b]).sum() < threshold * n_item:
            continue
        # seeds one after another on a diagonal make up a maximal match
        diagonal = at[a:b] - place[a:b]
        new = np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (np.diff(place[a:b]) > 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], b - a) - 1
        runs = [(int(place[a + y] + size[a + y] - place[a + x]), int(place[a + x]), int(at[a + x])) for x, y in zip(first, last, strict=True)]
        covered = sum(t[0] for t in tile(runs, n_item, min(items.least, n_item)))
        if covered >= threshold * n_item:
            yield int(doc[a]), int(item[a]), covered


def blocks(benchmark: DataFrame, least: int, block_mb: float) -> Iterator[Items]:
    """The benchmark in parts of bounded size, by a hash of its rows."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # an item's text and id, with what its tokens take as hashes
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // int(block_mb * 1e6)))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        found = part.orderBy("item_id", "text").collect()
        if found:
            yield Items([r[0] for r in found], [r[1] for r in found], least)


def _found(batches: Iterator[pa.RecordBatch], items: Items, threshold: float) -> Iterator[pa.RecordBatch]:
    """Batches with doc_id, text and found, an array of (item_id, covered, n_tokens), longer by what this block has."""
    kind = pa.struct([("item_id", pa.int64()), ("covered", pa.int64()), ("n_tokens", pa.int64())])
    for batch in batches:
        for part in tx.slabs(batch, "text"):
            more: dict[int, list[dict]] = {}
            for d, i, covered in compare(part, items, threshold):
                more.setdefault(d, []).append({"item_id": items.ids[i], "covered": covered, "n_tokens": int(items.firsts[i + 1] - items.firsts[i])})
            had = part.column("found")
            if more:
                had = pa.array([(old or []) + more.get(d, []) for d, old in enumerate(had.to_pylist())], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), had], ["doc_id", "text", "found"])


def findings(docs: DataFrame, benchmark: DataFrame, threshold: float, least: int, block_mb: float, at_once: int = 4) -> DataFrame:
    """doc_id and found, an array of (item_id, covered, n_tokens) that reach the threshold, of every row of docs."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, text string, found array<struct<item_id:long,covered:long,n_tokens:long>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr("cast(array() AS array<struct<item_id:bigint,covered:bigint,n_tokens:bigint>>)").alias("found"))
    sent = []
    for k, items in enumerate(blocks(benchmark, least, block_mb)):
        if k and k % at_once == 0:
            rows = stage(rows, f"found{k}")
            while sent:
                sent.pop().unpersist()
        sent.append(docs.sparkSession.sparkContext.broadcast(items))
        rows = rows.mapInArrow(lambda batches, b=sent[-1]: _found(batches, b.value, threshold), schema)
    return rows.select("doc_id", "found")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, block_mb: float = 8.0) -> DataFrame:
    """Pairs that reach the threshold: doc_id, item_id, covered, n_tokens, coverage."""
    one = findings(docs, benchmark, threshold, least, block_mb).select("doc_id", F.explode("found").alias("f"))
    return one.select("doc_id", "f.item_id", "f.covered", "f.n_tokens", (F.col("f.covered") / F.col("f.n_tokens")).alias("coverage"))


def flag(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, block_mb: float = 8.0) -> DataFrame:
    """One row per document: doc_id, contaminated, the largest coverage (0 below the threshold) and the items found."""
    rows = findings(docs, benchmark, threshold, least, block_mb)
    items = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["item_id"])))
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["covered"] / f["n_tokens"])), F.lit(0.0))
    return rows.select("doc_id", (F.size("found") > 0).alias("contaminated"), best.alias("coverage"), F.size(items).cast("int").alias("n_items"), items.alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, block_mb: float = 8.0, at_once: int = 4) -> DataFrame:
    """docs without those that hold an item; rows pass from block to block in one scan, and none is shuffled."""
    bounded_batches(docs.sparkSession)
    schema, sent = docs.schema, []
    for k, items in enumerate(blocks(benchmark, least, block_mb)):
        if k and k % at_once == 0:
            docs = stage(docs, f"clean{k}")
            while sent:
                sent.pop().unpersist()
        sent.append(docs.sparkSession.sparkContext.broadcast(items))

        def kept(batches: Iterator[pa.RecordBatch], b=sent[-1]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tx.slabs(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, _, _ in compare(part, b.value, threshold)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(kept, schema)
    return docs
