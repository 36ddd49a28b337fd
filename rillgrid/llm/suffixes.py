"""Suffix-array dedup of bytes, one suffix array per shard.

A shard holds the segments of the anchors dealt to it (see windows.py).  Segments that stand
several times are found by that alone; the distinct ones are sorted by Larsson-Sadakane
refinement: suffixes by their first 8 bytes, and then only groups of equals, by the rank of the
suffix twice as far on, until no group is left that differs before its segments' ends.  Kasai's walk
gives common prefixes, all segments in step, up to `window`.  A window has a partner if its
suffix shares `window` bytes with a neighbour in the array.  For an anchor that is dealt over
several shards, the shards' windows without a partner are merged: sorted by fingerprint, each is
looked up among the others by binary search.

Cases: a null or empty text has no bytes; texts under `window` bytes keep all; of equal texts
that are long enough, each loses all its bytes; doc_id is the key, rows that share one count as copies
of one another; an empty table gives an empty result; columns other than doc_id and text are
ignored.  Removal is by byte and may cut a character; kept bytes are then no valid UTF-8 and are
returned as binary.  Memory follows a shard's segments and the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .substring import removed_units
from .windows import Units, find, report, runs, spread, unsettled

BYTES = Units(False)


def suffix_array(s: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: suffixes in order, and ranks (a group's first place).

    left: bytes to the end of each suffix's own segment; beyond it a suffix has no bytes, and is
    smaller than one that goes on.  Equal suffixes stand by place, so that the suffixes that
    follow them stand in the same order, on which Kasai's walk relies.
    """
    depth = int(left.max(initial=0))
    n = len(s)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # eight bytes at a time; UTF-8 has no byte 0xFF, so that bytes from 1 leave 0 for what is beyond the end
    wide = np.concatenate([s + np.uint8(1), np.zeros(16, np.uint8)])
    key = np.empty(n, np.uint64)
    for k in range(8):
        part = key[k::8]
        part[:] = wide[k : k + 8 * len(part)].view(">u8")
    tail = np.flatnonzero(left < 8)
    key[tail] &= ~((np.uint64(1) << (8 * (8 - left[tail])).astype(np.uint64)) - np.uint64(1))
    order = np.argsort(key)
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    size = np.diff(np.append(begin, n))
    # places in the array whose group has several suffixes
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    have = 8
    while have < depth and len(open_):
        i = order[open_]
        after = np.where(left[i] > have, rank[np.minimum(i + have, n - 1)] + 1, 0)
        key = rank[i] * (n + 2) + after
        by = np.argsort(key)
        order[open_] = i = i[by]
        k = key[by]
        new = np.ones(len(i), bool)
        new[1:] = k[1:] != k[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(i)))
        rank[i] = np.repeat(open_[begin], size)
        open_ = open_[np.repeat(size > 1, size)]
        have *= 2
    if len(open_):
        i = order[open_]
        order[open_] = i[np.lexsort((i, rank[i]))]
    return order, rank


def common_prefixes(s: np.ndarray, offs: np.ndarray, left: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix, by place in s, the bytes it shares with the one before it in the array, up to `most`.

    Kasai's walk of each segment from left to right: the next suffix shares at least one byte
    less.  All segments walk at once; each compares one byte or goes on to its next suffix.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    at, end = offs[:-1][np.diff(offs) > 0].copy(), offs[1:][np.diff(offs) > 0]
    h = np.zeros(len(at), np.int64)
    while len(at):
        j = before[at]
        reach = np.minimum(np.minimum(left[at], np.where(j >= 0, left[j], 0)), most)
        more = h < reach
        a, b = np.where(more, at + h, 0), np.where(more, j + h, 0)
        more &= s[a] == s[b]
        done = ~more
        out[at[done]] = h[done]
        h += np.where(more, 1, -np.minimum(h, 1))
        at = at + done
        live = at < end
        if not live.all():
            at, end, h = at[live], end[live], h[live]
    return out


def shard(window: int):
    def searched(x: dict) -> Iterator[pa.RecordBatch]:
        buf, offs = x["buf"], x["offs"]
        kind, first, member = np.unique(tx.group_hash(tx.mix(buf, 3), offs, 4), return_index=True, return_inverse=True)
        times = np.bincount(member, x["times"])
        n = np.diff(offs)[first]
        cut = np.concatenate([[0], np.cumsum(n)])
        s = buf[np.repeat(offs[:-1][first] - cut[:-1], n) + np.arange(cut[-1])]
        left = np.repeat(cut[1:], n) - np.arange(len(s))
        order, _ = suffix_array(s, left)
        shared = common_prefixes(s, cut, left, order, window)
        high = np.concatenate([shared[order[1:]], [0]]) if len(order) else shared
        twice = np.zeros(len(s), bool)
        twice[order] = high >= window
        twice |= shared >= window
        twice |= np.repeat(times > 1, n)
        m = np.diff(offs) - window + 1
        seg = np.repeat(np.arange(len(m)), m)
        rel = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        gone = twice[cut[member[seg]] + rel]
        yield report(*spread(x, *runs(seg[gone], rel[gone])))
        # of a hot anchor's windows, one of each kind has to be known to the other shards
        seen = np.flatnonzero(x["salted"][seg])
        if len(seen):
            h = tx.mix(buf, 3)
            at = offs[seg[seen]] + rel[seen]
            alone = ~gone[seen]
            alone[np.unique(tx.rolling(h, window, 21)[at], return_index=True)[1]] = True
            yield unsettled(x, h, at[alone], seg[seen[alone]], rel[seen[alone]], window, True)

    return searched


def merge(rows: DataFrame, limit: int = 1 << 17) -> DataFrame:
    """Windows of different shards of a hot anchor that are equal.

    The shards' windows are merged into one order, by fingerprint; of each part of it, of about
    `limit` rows and cut where the fingerprint changes, a window is looked up by binary search.
    """

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) < limit:
                    continue
            if not waiting:
                continue
            t = pa.Table.from_batches(waiting)
            f = np.stack([t.column(c).to_numpy() for c in ("f1", "f2")], 1)
            line = np.ascontiguousarray(f).view([("f1", np.int64), ("f2", np.int64)]).ravel()
            # the last fingerprint may go on in the next batch
            whole = len(line) if batch is None else int(np.searchsorted(line, line[-1], "left"))
            line, rest = line[:whole], t.slice(whole)
            found = np.searchsorted(line, line, "right") - np.searchsorted(line, line, "left") > 1
            yield from t.slice(0, whole).select(["doc_id", "first", "last"]).filter(pa.array(found)).to_batches()
            waiting = rest.to_batches()

    return rows.repartition("f1", "f2").sortWithinPartitions("f1", "f2").mapInArrow(looked_up, "doc_id long, first int, last int")


def _finish(window: int, with_text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text"):
                buf, offs = tx.buffers(part.column("text"))
                gone = removed_units(part, offs, window)
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                begin[offs[:-1][offs[:-1] < len(gone)]] = gone[offs[:-1][offs[:-1] < len(gone)]]
                out = buf[~gone].tobytes()
                cut = np.concatenate([[0], np.cumsum(tx.per_group(~gone, offs))]).tolist()
                kept = [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                columns = [part.column("doc_id"), pa.array(np.diff(offs)), pa.array(tx.per_group(gone, offs)), pa.array(tx.per_group(begin, offs)), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    return finish


def dedup(docs: DataFrame, window: int = 400, gram: int = 32, hot: int = 1_000, shard_mb: float = 0.5, with_text: bool = False) -> DataFrame:
    """Removes every byte of a `window`-byte string that starts anywhere else too.

    One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and `kept` if with_text.
    """
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return find(docs, BYTES, window, gram, False, shard(window), merge, _finish(window, with_text), result, hot, shard_mb)
