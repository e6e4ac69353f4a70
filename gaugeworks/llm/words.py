"""Words and word shingles of whole texts as 64-bit hashes, a batch at a time.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z are lowered.
Everything here works on a slice of an Arrow batch inside a task, in a few numpy
passes over its bytes; ``slices`` keeps the work space of these passes small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, one row at least.

    Buffers of earlier batches go back to the system first: workers live on
    between tasks, and share their executor's memory with the JVM.
    """
    pa.default_memory_pool().release_unused()
    size = utf8(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


class Words:
    """Word hashes of a batch: ``hashes`` in order, those of row i at ``rows[i]:rows[i+1]``.

    ``starts`` and ``ends`` are byte places of the words in the batch's bytes,
    ``base[i]`` is the byte at which row i begins.
    """

    def __init__(self, column: pa.Array):
        raw, at = utf8(column)
        n = len(raw)
        self.base = at
        low = np.zeros(n + 8, dtype=np.uint8)
        np.take(_LOWER, raw, out=low[:n])
        inside = np.zeros(n + 2, dtype=bool)
        np.logical_not(_SPACE[raw], out=inside[1 : n + 1])
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        self.starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
        self.ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | edge[1:])) + 1
        self.rows = np.searchsorted(self.starts, at)
        size = self.ends - self.starts
        view = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=low, strides=(1,))
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        #: the first eight bytes of each word, lowered
        self.lead = view[self.starts] & _MASK[np.minimum(size, 8)]
        which, off = np.arange(len(size)), 0
        while len(which):
            part = view[self.starts[which] + off] & _MASK[np.minimum(size[which] - off, 8)]
            h[which] = mix(h[which] ^ part) * np.uint64(0xA24BAED4963EE407)
            off += 8
            which = which[size[which] > off]
            if off >= _LONG:
                for i in which:
                    whole = hashlib.blake2b(low[self.starts[i] : self.ends[i]].tobytes(), digest_size=8)
                    h[i] = np.uint64(int.from_bytes(whole.digest(), "little"))
                break
        self.hashes = mix(h)

    def grams(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words within a row, in order, and row offsets into them."""
        w, n = self.hashes, len(self.hashes)
        count = np.maximum(np.diff(self.rows) - width + 1, 0)
        rows = np.concatenate([[0], np.cumsum(count)])
        if not rows[-1]:
            return np.zeros(0, dtype=np.uint64), rows
        full = rolling(w, width)
        take = np.ones(n - width + 1, dtype=bool)
        for k in range(1, width):  # runs that would cross into the next row
            at = self.rows[1:-1] - k
            take[at[(at >= 0) & (at < len(take))]] = False
        # rows shorter than the width own none of the runs that begin in them
        return full[take], rows

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """As ``grams``, but a row of fewer words, one at least, has its whole sequence as one."""
        g, rows = self.grams(width)
        count = np.diff(self.rows)
        short = np.flatnonzero((count > 0) & (count < width))
        if not len(short):
            return g, rows
        own = [mix(rolling(self.hashes[self.rows[i] : self.rows[i + 1]], int(count[i])) + np.uint64(count[i])) for i in short]
        return np.insert(g, rows[short], np.concatenate(own)), rows + np.concatenate([[0], np.cumsum((count > 0) & (count < width))])


def rolling(w: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries; depends on their order."""
    h = np.zeros(len(w) - width + 1, dtype=np.uint64)
    if width <= 8:
        for k, c in enumerate(odd_constants(width, 77)):
            h += (w[k : k + len(h)] ^ c) * c
        return mix(h)
    # polynomial in an odd base, modulo 2**64, from prefix sums
    base = 0x9FB21C651E98DF25
    power = np.cumprod(np.full(len(w), base, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(w * power, dtype=np.uint64)])
    back = pow(base, -1, 1 << 64)
    undo = np.cumprod(np.full(len(h), back, dtype=np.uint64))
    return mix((total[width:] - total[:-width]) * undo)


def distinct_sorted(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, with new row offsets."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[first], np.concatenate([[0], np.cumsum(np.bincount(o[first], minlength=len(rows) - 1))]).astype(np.int64)
