"""The E8 lattice: nearest points, cell keys and neighbouring cells."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np

from .words import mix, odd_constants


def _shortest() -> np.ndarray:
    """The 240 shortest vectors: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


SHORTEST = _shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    gap = x - r
    worst = np.argmax(np.abs(gap), axis=1)
    rows = np.flatnonzero(r.sum(axis=1) % 2)
    at = worst[rows]
    r[rows, at] += np.where(gap[rows, at] >= 0, 1.0, -1.0)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points of the rows of ``x`` (n x 8): the better of two shifted even lattices."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def keys(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of lattice points (... x 8)."""
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    h = np.zeros(points.shape[:-1], dtype=np.uint64)
    for k, c in enumerate(odd_constants(8, salt)):
        h += mix(twice[..., k] + c) * c
    return mix(h).view(np.int64)


def around(x: np.ndarray, points: np.ndarray, count: int) -> np.ndarray:
    """For each row the ``count`` neighbouring lattice points that are nearest to ``x`` (n x count x 8)."""
    score = (x - points) @ SHORTEST.T
    best = np.argpartition(-score, count - 1, axis=1)[:, :count]
    return points[:, None, :] + SHORTEST[best]
