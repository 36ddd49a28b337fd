"""Tokenising and hashing of UTF-8 text with numpy, over Arrow's string buffers.

Nothing here makes a Python string per word.  A batch's texts are one byte array with
offsets; words are (start, end) pairs in it and carry a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at a time, which bounds the temporary arrays.
CHUNK = 1 << 20

#: The ASCII white space that ends a word: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but digits, a to z and bytes of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower-cases A to Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers.get("r", ())) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("r", _R), ("i", _RI)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["r"], _powers["i"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on every input bit."""
    x = x.astype(U64, copy=True)
    x += U64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slabs(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text each, at least one row, so that memory doesn't follow the batch."""
    _, offs = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's first word (n + 1 of them)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = gap[buf]
    edge = np.empty(n + 1, bool)
    edge[0] = True
    edge[1:] = space
    edge[offs] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[:n] = space
    edge[n] = True
    edge[offs] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order of their ends.  fold: a table applied to bytes first."""
    n = len(starts)
    out = np.empty(n, U64)
    at = 0
    while at < n:
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        size = max(int(ends[to - 1]) - low, 0)
        part = buf[low : low + size]
        if fold is not None:
            part = fold[part]
        up, down = _power(size + 1)
        total = np.zeros(size + 1, U64)
        np.cumsum((part.astype(U64) + U64(1 + seed)) * up[:size], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return mix(out, seed)


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k hashes: len(h) - k + 1 of them."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1], seed)


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each span's sequence of hashes, spans anywhere in h."""
    up, down = _power(len(h) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + mix((ends - starts).astype(U64), seed + 1), seed)


def group_hash(h: np.ndarray, offs: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each group's sequence of hashes; groups are h[offs[i]:offs[i + 1]]."""
    return span_hash(h, offs[:-1], offs[1:], seed)


def per_group(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of x over groups, empty ones included."""
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def owners(offs: np.ndarray) -> np.ndarray:
    """Each item's group."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0
