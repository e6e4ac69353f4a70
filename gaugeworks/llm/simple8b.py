"""Simple-8b: word-aligned packing of unsigned integers, vectorised both ways.

A 64-bit word has a selector in its top four bits and ``COUNTS[s]`` values of
``60 // COUNTS[s]`` bits below, the first in the lowest bits.  Values come in
blocks of ``BLOCK``, each starting a new word; the words of a block are found by
its offset.  A value of more than 60 bits is an escape: selector 15, with its
place in a list of whole values as the payload.
"""

from __future__ import annotations

import numpy as np

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = 60 // COUNTS
BLOCK, ESCAPE = 240, 15


def _lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least one; beyond 53 bits maybe one too many, which only costs an escape."""
    return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, block offsets into them (one more than blocks) and escaped values."""
    words, offsets, escaped, done = [], [np.zeros(1, np.int64)], [], 0
    for at in range(0, len(values), 1000 * BLOCK):  # bounded work space
        w, o, e = _encode(values[at : at + 1000 * BLOCK])
        if len(e):
            w[w >> np.uint64(60) == ESCAPE] += np.uint64(sum(map(len, escaped)))
        words.append(w)
        offsets.append(o[1:] + done)
        escaped.append(e)
        done += len(w)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *words]), np.concatenate(offsets), np.concatenate([none, *escaped])


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``encode``, of a few blocks, one at least."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK + 60), dtype=np.uint64)
    full = np.zeros(blocks * BLOCK, dtype=np.uint64)
    full[:n] = values
    padded[:, :BLOCK] = full.reshape(blocks, BLOCK)
    bits = _lengths(padded)
    # largest length among the next c values, for each c
    choice = np.full((blocks, BLOCK), len(COUNTS), dtype=np.uint8)
    spans = {1: bits}
    span = 1
    while span < 32:
        prev = spans[span]
        spans[2 * span] = np.maximum(prev[:, :-span], prev[:, span:])
        span *= 2
    for s in range(len(COUNTS) - 1, -1, -1):
        c = int(COUNTS[s])
        k = 1 << (c.bit_length() - 1)
        top = spans[k][:, :BLOCK] if c == k else np.maximum(spans[k][:, :BLOCK], spans[k][:, c - k : c - k + BLOCK])
        choice[top <= BITS[s]] = s
    # all blocks advance together, a word each
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    taken = np.append(COUNTS, 1)
    at, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    block_of, place = [], []
    while len(live):
        block_of.append(live)
        place.append(at[live].copy())
        at[live] += taken[choice[live, at[live]]]
        live = live[at[live] < size[live]]
    block_of, place = np.concatenate(block_of), np.concatenate(place)
    order = np.argsort(block_of, kind="stable")
    block_of, place = block_of[order], place[order]
    chosen = choice[block_of, place]
    words = np.zeros(len(chosen), dtype=np.uint64)
    for s, c in enumerate(COUNTS):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            part = padded[block_of[rows][:, None], place[rows][:, None] + np.arange(c)]
            shift = (np.arange(c) * BITS[s]).astype(np.uint64)
            words[rows] = np.bitwise_or.reduce(part << shift, axis=1) | (np.uint64(s) << np.uint64(60))
    rows = np.flatnonzero(chosen == len(COUNTS))
    escaped = padded[block_of[rows], place[rows]]
    words[rows] = np.arange(len(rows), dtype=np.uint64) | (np.uint64(ESCAPE) << np.uint64(60))
    return words, np.concatenate([[0], np.cumsum(np.bincount(block_of, minlength=blocks))]), escaped


def decode(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    taken = np.ones(16, dtype=np.int64)
    taken[: len(COUNTS)] = COUNTS
    count = taken[selector]
    total = np.cumsum(count) - count
    block_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = total - total[offsets[:-1]][block_of]
    out = np.zeros((len(offsets) - 1, BLOCK + 60), dtype=np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for s, c in enumerate(COUNTS):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            shift = (np.arange(c) * BITS[s]).astype(np.uint64)
            out[block_of[rows][:, None], place[rows][:, None] + np.arange(c)] = (payload[rows][:, None] >> shift) & np.uint64((1 << int(BITS[s])) - 1)
    rows = np.flatnonzero(selector == ESCAPE)
    out[block_of[rows], place[rows]] = escaped[payload[rows].astype(np.int64)]
    return out[:, :BLOCK].reshape(-1)[:n]
