"""Gradient-boosted trees on binned features and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.15, 32, 5.0


@dataclass
class Boosted:
    """Trees as arrays: split feature (-1: leaf), split value, leaf value; node i has children 2i+1, 2i+2."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, value, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > value[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            out += leaf[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x (pool adjacent violators)."""
    ux, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    mean = np.bincount(at, weights=y) / weight
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for m, w, v in zip(mean, weight, ux, strict=True):
        blocks.append([m, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    knots = [(v, b[0]) for b in blocks for v in dict.fromkeys(b[2:])]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nodes = 2 ** (DEPTH + 1) - 1
    feature, value, leaf = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    node = np.zeros(len(g), dtype=np.int64)
    for level in range(DEPTH + 1):
        for i in range(2**level - 1, 2 ** (level + 1) - 1):
            rows = np.flatnonzero(node == i)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            leaf[i] = -RATE * gs / (hs + 1.0)
            if level == DEPTH:
                continue
            best, cut = 1e-6, None
            for f in range(binned.shape[1]):
                gl = np.cumsum(np.bincount(binned[rows, f], weights=g[rows], minlength=BINS))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], weights=h[rows], minlength=BINS))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                n = np.cumsum(np.bincount(binned[rows, f], minlength=BINS))[:-1]
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
                k = int(gain.argmax())
                if gain[k] > best and k < len(edges[f]):
                    best, cut = gain[k], (f, k)
            if cut:
                f, k = cut
                feature[i], value[i] = f, edges[f][k]
                node[rows] = 2 * i + 1 + (binned[rows, f] > k)
    return feature, value, leaf, leaf[node]


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Boosted:
    """Boost on the rows outside ``held``, calibrate on those inside (on all if one side lacks a class)."""
    if not len(y):
        return Boosted()
    if len(set(y)) < 2:
        return Boosted(steps=(np.array([0.0]), np.array([float(y.mean())])))
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    xt, yt = x[~held], y[~held]
    edges = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [np.unique(np.concatenate([[xt[:, f].min()], e]))[: BINS - 1] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, xt[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    model = Boosted(start=float(np.log(yt.mean() / (1 - yt.mean()))))
    out = np.full(len(yt), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-out))
        *tree, change = _grow(binned, edges, p - yt, p * (1 - p))
        model.trees.append(tuple(tree))
        out += change
    use = held if held.any() else np.ones(len(y), dtype=bool)
    model.steps = isotonic(model.raw(x[use]), y[use].astype(float))
    return model
