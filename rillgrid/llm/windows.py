"""What substring and suffix-array dedup share: which passages need a look, and who looks at them.

A unit is a word or a byte; a window is `window` units of one document.  Both operators ask of
each window where else it stands.  Windows are dealt by content, so that equal windows always
meet, though no task sees all documents:

1. Documents of equal content are one class; only its smallest doc_id goes on.
2. A window's anchor is the gram of `gram` units with the smallest hash in it, the leftmost of
   equals.  Equal windows have equal anchors at equal places.  Neighbouring windows mostly share
   theirs, so a document has about 2 / (window - gram) anchors a unit.  A window holds at least
   half of its other units on one side of the anchor, at its end or else its start; the anchor
   with that half is the window's key.
3. A key that stands once (or in one document, if only other documents count) rules out its
   windows.  Of the others, a segment is cut for each run of windows with one key, and dealt to
   shards by the key.
   A task sorts its segments by key and takes `shard_mb` of them at a time, so that a shard is a
   range of keys of bounded size, whatever the corpus.
4. Keys of more than `hot` segments are dealt over several shards.  There a window without a
   partner may have one in another shard of the key; it's passed on by fingerprint.

Nothing is dropped: keys only rule out windows that can't have a partner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import bounded_batches, fewer, partitions, stage, text_bytes, texts

U64 = np.uint64
_MASK = U64(0xFFFFFFFFFF000000)


class Units:
    """How a text splits into units: hashes, each document's first unit, and each unit's first and last byte."""

    def __init__(self, by_word: bool):
        self.by_word = by_word
        # bytes of text at a time: a byte's unit takes as much memory as a word's
        self.slab = tx.CHUNK if by_word else tx.CHUNK // 4

    def split(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self.by_word:
            starts, ends, firsts = tx.words(buf, offs)
            return tx.hash_spans(buf, starts, ends), firsts, starts, ends
        at = np.arange(len(buf), dtype=np.int64)
        return _BYTE[buf], offs, at, at + 1


_BYTE = tx.mix(np.arange(256), 3)


def least(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours: len(key) - width + 1 of them."""
    out, have = key, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def leftmost(g: np.ndarray, width: int) -> np.ndarray:
    """Where the minimum, the leftmost of equals by the mask, of each `width` neighbours stands.

    A place has only the bits that the mask leaves, so g is taken in overlapping blocks of no more than these hold.
    """
    block = int(~_MASK) + 1
    if width > block:
        raise ValueError(f"windows of over {block} grams")
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(g) - width + 1, block - width + 1):
        part = g[at : at + block]
        out.append((least((part & _MASK) | np.arange(len(part), dtype=U64), width) & ~_MASK).astype(np.int64) + at)
    return np.concatenate(out)


def anchors(h: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: document, first window, the one after the last, and the key.

    Windows are numbered by their first unit in the whole batch.
    """
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, np.zeros(0, U64)
    half = (window - gram) // 2
    g = tx.rolling(h, gram, 5)
    place = leftmost(g, window - gram + 1)
    own = tx.owners(firsts)
    at = np.flatnonzero(own[: len(place)] == own[window - 1 :][: len(place)])
    if not len(at):
        return none, none, none, np.zeros(0, U64)
    place = place[at]
    before = place - at >= half
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (before[1:] != before[:-1]) | (own[at][1:] != own[at][:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    place, before = place[begin], before[begin]
    key = tx.span_hash(h, place - half * before, place + gram + half * ~before, 23) ^ np.where(before, U64(0), U64(0x5851F42D4C957F2D))
    return own[at[begin]], at[begin], at[end] + 1, key


def outline(docs: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """doc_id, n_units, two hashes of the content, and the distinct anchors' hashes and counts in the document."""

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text", units.slab):
                h, firsts, _, _ = units.split(*tx.buffers(part.column("text")))
                doc, _, _, anchor = anchors(h, firsts, window, gram)
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                at = np.flatnonzero(new)
                cut = pa.array(np.searchsorted(doc[at], np.arange(len(firsts))), pa.int32())
                times = np.diff(np.append(at, len(doc)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(firsts)), pa.array(tx.group_hash(h, firsts, 1).view(np.int64)), pa.array(tx.group_hash(h, firsts, 2).view(np.int64)),
                     pa.ListArray.from_arrays(cut, pa.array(anchor[at].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times, pa.int32()))],
                    ["doc_id", "n_units", "c1", "c2", "anchor", "n"],
                )

    return docs.mapInArrow(outlined, "doc_id long, n_units long, c1 long, c2 long, anchor array<long>, n array<int>")


def _segments(units: Units, window: int, gram: int, hot: int):
    """From documents and their repeated anchors: distinct segments of each document, with their first units."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slabs(batch, "text", units.slab):
                buf, offs = tx.buffers(part.column("text"))
                h, firsts, starts, ends = units.split(buf, offs)
                doc, low, high, anchor = anchors(h, firsts, window, gram)
                lists = part.column("anchors")
                known = lists.flatten().to_numpy().view(np.uint64) ^ tx.mix(np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), 15)
                if not len(doc) or not len(known):
                    continue
                order = np.argsort(known)
                known, counted = known[order], part.column("times").flatten().to_numpy()[order]
                key = anchor ^ tx.mix(doc, 15)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                r = np.flatnonzero(known[at] == key)
                if not len(r):
                    continue
                times, d, anchor = counted[at[r]], doc[r], anchor[r]
                first, last = low[r], high[r] + window - 2
                # equal segments of a document, as in periodic texts, are one with several places
                content = tx.span_hash(h, first, last + 1, 17) ^ tx.mix(d, 15)
                _, one, which = np.unique(content, return_index=True, return_inverse=True)
                by = np.argsort(which, kind="stable")
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(which))]), pa.int32()), pa.array((first - firsts[d])[by], pa.int32()))
                ids = part.column("doc_id").to_numpy()[d[one]]
                salts = -(-times[one] // hot)
                salt = tx.mix(ids, 11) % salts.astype(U64)
                shard = tx.mix(anchor[one] + salt * U64(0x9E3779B97F4A7C15), 13).view(np.int64)
                raw = buf.tobytes()
                seg = pa.array([raw[x:y] for x, y in zip(starts[first[one]].tolist(), ends[last[one]].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids), places, seg, pa.array(salts > 1)], ["shard", "doc_id", "firsts", "seg", "salted"])

    return cut


#: What a shard reports: runs of windows [first, last) of a document, found to have a partner, or
#: a fingerprint (f1, f2) of a window that has none in this shard of a hot anchor.
REPORT = "doc_id long, first int, last int, f1 long, f2 long"


def report(doc_id, first, last, f1=None, f2=None) -> pa.RecordBatch:
    n = len(doc_id)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(doc_id, np.int64)), pa.array(np.asarray(first), pa.int32()), pa.array(np.asarray(last), pa.int32()), none if f1 is None else pa.array(np.asarray(f1).view(np.int64)), none if f2 is None else pa.array(np.asarray(f2).view(np.int64))],
        ["doc_id", "first", "last", "f1", "f2"],
    )


def unsettled(x: dict, h: np.ndarray, at: np.ndarray, row: np.ndarray, rel: np.ndarray, window: int, once: bool) -> pa.RecordBatch:
    """Windows at `at` of h, the rel-th of their segments, by fingerprint, at all their places or once each."""
    n = np.ones(len(row), np.int64) if once else x["times"][row]
    pick = np.repeat(x["cut"][row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    first = x["firsts"][pick] + np.repeat(rel, n)
    f1, f2 = (np.repeat(tx.rolling(h, window, k)[at], n) for k in (21, 22))
    return report(np.repeat(x["doc_id"][row], n), first, first + 1, f1, f2)


def spread(x: dict, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of segments (row, first, last in the segment) as runs of their documents, joined where they touch."""
    n = x["times"][row]
    pick = np.repeat(x["cut"][row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    doc = np.repeat(x["doc_id"][row], n)
    a, b = x["firsts"][pick] + np.repeat(first, n), x["firsts"][pick] + np.repeat(last, n)
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(doc):
        return doc, a, b
    # an anchor's windows in a document don't overlap, so ends are in order too
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (a[1:] > b[:-1])
    at = np.flatnonzero(new)
    return doc[at], a[at], np.maximum.reduceat(b, at)


def runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted positions of owners as maximal runs: owner, first, after the last."""
    if not len(at):
        return owner, at, at
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    a = np.flatnonzero(new)
    return owner[a], at[a], at[np.append(a[1:], len(at)) - 1] + 1


def slabs_of_keys(batches: Iterator[pa.RecordBatch], shard: Callable[[dict], Iterator[pa.RecordBatch]], limit: int) -> Iterator[pa.RecordBatch]:
    """Hands a partition's segments, sorted by their shard key, to `shard` as arrays, `limit` bytes at a time.

    A slab ends where the key changes, so what has to meet does; memory follows `limit` and the
    largest key, which holds about `hot` segments at most, and not the partition.
    """
    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.column("seg").nbytes
        if size >= 2 * limit:
            table = pa.Table.from_batches(waiting).combine_chunks()
            key = table.column("shard").to_numpy()
            _, offs = tx.buffers(table.column("seg"))
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1
            at = 0
            while True:
                to = ends[np.searchsorted(ends, np.searchsorted(offs, offs[at] + limit)) :]
                if not len(to):
                    break
                yield from shard(_arrays(table.slice(at, int(to[0]) - at)))
                at = int(to[0])
            rest = table.slice(at)
            waiting, size = rest.to_batches(), int(offs[-1] - offs[at])
    if waiting:
        yield from shard(_arrays(pa.Table.from_batches(waiting)))


def _arrays(table: pa.Table) -> dict:
    table = table.combine_chunks()
    buf, offs = tx.buffers(table.column("seg"))
    places = table.column("firsts").combine_chunks()
    times = places.value_lengths().to_numpy().astype(np.int64)
    return {"buf": buf, "offs": offs, "doc_id": table.column("doc_id").to_numpy(), "firsts": places.flatten().to_numpy().astype(np.int64), "times": times, "cut": np.cumsum(times) - times, "salted": table.column("salted").to_numpy()}


def find(docs: DataFrame, units: Units, window: int, gram: int, across: bool, shard: Callable[[dict], Iterator[pa.RecordBatch]], merge: Callable[[DataFrame], DataFrame], finish: Callable, result: str, hot: int, shard_mb: float) -> DataFrame:
    """Runs the steps above and `finish` on each document with its windows that have a partner.

    across: only windows of other documents count.  shard: a shard's segments to REPORT rows.
    merge: the rows with fingerprints to (doc_id, first, last) of those with a partner.
    finish: batches of doc_id, text, twin (of a class of several, or not its smallest if across)
    and the arrays firsts and lasts, to rows of `result`.
    """
    bounded_batches(docs.sparkSession)
    docs = texts(docs)
    size = text_bytes(docs)
    n = partitions(docs, 32, size)
    seen = stage(fewer(outline(docs, units, window, gram), size), "outline")
    # a text shorter than a window loses nothing, however often it stands.  A class's other documents are those
    # that are not its smallest: met by doc_id, so that a class of very many copies is no group anywhere.
    long = seen.filter(F.col("n_units") >= window).select("doc_id", "c1", "c2")
    smallest = long.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"))
    marked = long.join(smallest.select("doc_id", "c1", "c2"), ["doc_id", "c1", "c2"], "left_anti").select("doc_id", F.lit(True).alias("later"))
    if not across:
        marked = marked.unionByName(smallest.filter("members > 1").select("doc_id", F.lit(False).alias("later")))
    marked = stage(marked, "classes")
    first = seen.join(marked.filter("later").select("doc_id"), "doc_id", "left_anti")
    stands = first.select("doc_id", F.explode(F.arrays_zip("anchor", "n")).alias("a")).select("doc_id", "a.anchor", "a.n")
    shared = stands.groupBy("anchor").agg(F.sum("n").alias("times"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = shared.filter("low <> high" if across else "times > 1").select("anchor", "times")
    look = stands.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("times").alias("times"))
    # one dealing of the texts by doc_id serves both joins
    dealt = docs.repartition(n, "doc_id")
    segments = dealt.join(look.hint("shuffle_hash"), "doc_id").mapInArrow(_segments(units, window, gram, hot), "shard long, doc_id long, firsts array<int>, seg binary, salted boolean")
    limit = int(shard_mb * 1e6)
    sorted_ = segments.repartition(n, "shard").sortWithinPartitions("shard")
    reports = stage(fewer(sorted_.mapInArrow(lambda b: slabs_of_keys(b, shard, limit), REPORT), size), "reports")
    found = reports.filter("f1 is null").select("doc_id", "first", "last").unionByName(merge(reports.filter("f1 is not null")))
    found = found.groupBy("doc_id").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    twins = marked.filter("later") if across else marked
    hints = found.join(twins.select("doc_id", F.lit(True).alias("twin")).distinct(), "doc_id", "full_outer")
    return dealt.join(hints.hint("shuffle_hash"), "doc_id", "left").mapInArrow(finish, result)
