"""Substring dedup of words by a compressed FM-index per shard.

A shard holds the segments of the anchors dealt to it (see windows.py).  Its index is the
Burrows-Wheeler transform of the distinct segments in a wavelet matrix of packed bits with block
counts.  Documents are streamed through it by backward search, all segments in step: the match
grows to the left up to `window` words, and then gives up its last word for each new one, so that
its length is the matching statistic of each place, cut off at `window`.  A streamed segment is
in the index itself, so the search can't fail; what matters is whose suffixes the interval holds.
A window is reported if the smallest doc_id in its interval is smaller than its own.

Cases: a null or empty text has no words and keeps the empty text; texts under `window` words
keep all; equal texts are removed but for the smallest doc_id's; doc_id is the key, and rows that
share one are taken as one document, so repeated rows don't remove one another; an empty table
gives an empty result; columns other than doc_id and text are ignored.  Words are compared by
64-bit hashes.  Memory follows a shard's segments and the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .windows import Units, find, report, runs, spread, unsettled

WORDS = Units(True)


def suffix_ranks(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of s in the order of their first `depth` symbols, ties by place; and each suffix's rank among distinct prefixes."""
    _, rank = np.unique(s, return_inverse=True)
    order, have = np.argsort(rank, kind="stable"), 1
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(len(s), np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (len(s) + 1) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)])
        rank = np.empty(len(s), np.int64)
        rank[order] = np.cumsum(new)
        have += step
        if rank[order[-1]] == len(s) - 1:
            break
    return order, rank


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, a packed bit vector with counts per 64 bits."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.rows, x = bits, [], s
        for level in range(bits - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            count = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=count[1:])
            zeros = len(x) - int(bit.sum())
            self.rows.append((packed, count, zeros))
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """How often each symbol stands before `at`; base: from start() of the symbols."""
        for level, (packed, count, zeros) in zip(range(self.bits - 1, -1, -1), self.rows, strict=True):
            word = at >> 6
            ones = count[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at - base

    def start(self, symbols: np.ndarray) -> np.ndarray:
        """What rank() has to take off for each symbol."""
        return self.rank(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))


class FMIndex:
    """Of sequences of symbols from 1, each with an owner: counts of smaller symbols, the transform and sampled owners."""

    def __init__(self, symbols: np.ndarray, offs: np.ndarray, owner: np.ndarray, window: int):
        n, self.window = len(offs) - 1, window
        s = np.zeros(len(symbols) + n, np.int64)
        s[np.arange(len(symbols)) + tx.owners(offs)] = symbols
        order, rank = suffix_ranks(s, window)
        sigma = int(s.max()) + 1 if len(s) else 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.wavelet = Wavelet(s[order - 1], max(1, int(sigma - 1).bit_length()))
        self.start = self.wavelet.start(np.arange(sigma))
        # beside the transform, 12 bytes a symbol: owners by their rank, and the wide intervals
        self.ids, rank_ = np.unique(owner, return_inverse=True)
        self.owner = rank_.astype(np.int32)[np.repeat(np.arange(n, dtype=np.int32), np.diff(offs) + 1)[order]]
        # intervals of equal prefixes of window - 1 symbols, to give up a match's last symbol
        h = np.concatenate([tx.rolling(tx.mix(s.astype(np.uint64), 2), window - 1), np.zeros(min(window - 2, len(s)), np.uint64)])[: len(s)]
        # a prefix that the text's end cuts off is a class of its own
        new = np.ones(len(s), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (order[1:] > len(s) - window + 1) | (order[:-1] > len(s) - window + 1)
        begin = np.flatnonzero(new).astype(np.int32)
        size = np.diff(np.append(begin, len(s)))
        self.wide = np.repeat(begin, size), np.repeat(begin + size, size).astype(np.int32)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the match that has one more symbol on its left."""
        base, c = self.start[symbol], self.below[symbol]
        return c + self.wavelet.rank(symbol, low, base), c + self.wavelet.rank(symbol, high, base)

    def intervals(self, symbols: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Backward search of all sequences in step: (sequence, low, high) of each whole window, the last windows first.

        Windows come by their distance from their sequence's end.
        """
        n = np.diff(offs)
        order = np.argsort(-n, kind="stable")
        lengths = -n[order]
        low, high, grown = np.zeros(len(n), np.int64), np.full(len(n), len(self.owner)), 0
        for back in range(int(n.max(initial=0))):
            live = order[: np.searchsorted(lengths, -back, "left")]
            a, b = low[live], high[live]
            if grown == self.window:
                a, b = self.wide[0][a].astype(np.int64), self.wide[1][a].astype(np.int64)
            else:
                grown += 1
            a, b = self.step(symbols[offs[live + 1] - 1 - back], a, b)
            low[live], high[live] = a, b
            if grown == self.window:
                yield live, a, b


def shard(window: int):
    def searched(x: dict) -> Iterator[pa.RecordBatch]:
        h, firsts, _, _ = WORDS.split(x["buf"], x["offs"])
        _, symbol = np.unique(h, return_inverse=True)
        # equal segments are one, of the smallest doc_id
        kind, first, member = np.unique(tx.group_hash(h, firsts, 4), return_index=True, return_inverse=True)
        smallest = np.full(len(kind), np.iinfo(np.int64).max)
        np.minimum.at(smallest, member, x["doc_id"])
        n = np.diff(firsts)[first]
        offs = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(firsts[:-1][first] - offs[:-1], n) + np.arange(offs[-1])
        symbols = symbol[take] + 1
        index = FMIndex(symbols, offs, smallest, window)
        # the smallest doc_id of each window, by segment
        least = np.full(len(symbols), np.iinfo(np.int64).max)
        back = window - 1
        for live, low, high in index.intervals(symbols, offs):
            span, which = np.unique(low, return_inverse=True)
            ends = np.zeros(len(span), np.int64)
            ends[which] = high
            edges = np.stack([span, np.minimum(ends, len(index.owner) - 1)], 1).ravel()
            found = np.minimum.reduceat(index.owner, edges)[::2]
            found = np.where(ends == len(index.owner), np.minimum(found, index.owner[-1]), found)
            least[offs[live + 1] - 1 - back] = index.ids[found[which]]
            back += 1
        # back to all segments
        m = np.diff(firsts) - window + 1
        seg = np.repeat(np.arange(len(m)), m)
        rel = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        low = least[offs[member[seg]] + rel]
        gone = low < x["doc_id"][seg]
        yield report(*spread(x, *runs(seg[gone], rel[gone])))
        stay = ~gone & x["salted"][seg]
        if stay.any():
            yield unsettled(x, h, firsts[seg[stay]] + rel[stay], seg[stay], rel[stay], window, False)

    return searched


def merge(rows: DataFrame) -> DataFrame:
    """Windows that were first in their shard of a hot anchor, but aren't first among its shards.

    A document's places of one window are one row meanwhile, so that a periodic text doesn't weigh
    on the task that its window meets others in: a window comes once from each shard at most.
    """
    places = rows.groupBy("doc_id", "f1", "f2").agg(F.collect_list("first").alias("places"))
    first = places.groupBy("f1", "f2").agg(F.min("doc_id").alias("smallest"))
    late = places.join(first, ["f1", "f2"]).filter("doc_id > smallest")
    return late.select("doc_id", F.explode("places").alias("first")).withColumn("last", F.col("first") + 1)


def removed_units(part: pa.RecordBatch, firsts: np.ndarray, window: int) -> np.ndarray:
    """Which units lie in a reported window, or in a twin long enough to hold one."""
    a, b = part.column("firsts"), part.column("lasts")
    doc = np.repeat(np.arange(part.num_rows), a.value_lengths().fill_null(0).to_numpy())
    low = firsts[doc] + a.flatten().to_numpy()
    high = firsts[doc] + b.flatten().to_numpy() + window - 1
    n = np.diff(firsts)
    twin = np.flatnonzero(part.column("twin").fill_null(False).to_numpy(zero_copy_only=False) & (n >= window))
    return tx.cover(int(firsts[-1]), np.concatenate([low, firsts[twin]]).astype(np.int64), np.concatenate([high, firsts[twin] + n[twin]]).astype(np.int64))


def _finish(window: int, with_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text"):
                buf, offs = tx.buffers(part.column("text"))
                starts, ends, firsts = tx.words(buf, offs)
                gone = removed_units(part, firsts, window)
                kept = np.flatnonzero(~gone)
                own = tx.owners(firsts)[kept]
                glue = kept[:-1][own[1:] == own[:-1]] if len(kept) else kept
                keep = tx.cover(len(buf), starts[kept], ends[kept])
                keep[ends[glue]] = True
                out = np.where(tx.SPACE[buf], np.uint8(32), buf)[keep].tobytes()
                cut = np.concatenate([[0], np.cumsum(tx.per_group(keep, offs))]).tolist()
                texts = [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                columns = [part.column("doc_id"), pa.array(np.diff(firsts)), pa.array(tx.per_group(gone, firsts)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    return finish


def dedup(docs: DataFrame, window: int = 50, gram: int = 8, hot: int = 2_000, shard_mb: float = 2.0, with_text: bool = False) -> DataFrame:
    """Removes the words of windows that a document with a smaller doc_id has too.

    One row per document: doc_id, n_words, n_removed, kept_sha256, and `kept` if with_text.
    """
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return find(docs, WORDS, window, gram, True, shard(window), merge, _finish(window, with_text), result, hot, shard_mb)
