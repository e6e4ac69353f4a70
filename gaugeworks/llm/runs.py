"""Maximal runs of a sequence after Kolpakov and Kucherov, with small memory a symbol.

A run is a stretch with a smallest period q that no neighbour extends.  Only
runs of at least ``power`` periods and ``least`` symbols are asked for, which
narrows every search below but changes none of its reasons:

* The sequence is cut into Lempel-Ziv factors with a suffix automaton: each
  factor is the longest stretch that also begins earlier (or a new symbol).
* A run that touches the front or end of a factor is found by Main's method:
  common prefixes and suffixes around the boundary, for every period at once.
  With factors ``u`` and ``v`` before and after a boundary, a run of period p
  that ends in ``v`` begins less than |u| + p before it (else ``u`` would have
  been longer), so (power - 1) * p < |u| + |v| bounds periods and window.
* A run strictly inside a factor occurs at the factor's earlier place as well
  and is copied from there.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort

import numpy as np


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (begin, length, earlier begin or -1) of non-negative symbols, by a suffix automaton.

    Most states have one way on, which is kept in flat arrays; only the others have a dict.
    """
    symbol, target = array("q", [-1]), array("q", [-1])
    link, length, first = array("q", [-1]), array("q", [0]), array("q", [-1])
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(s):
        new = len(link)
        symbol.append(-1), target.append(-1), link.append(0), length.append(i + 1), first.append(i)
        p, q = last, -1
        while p >= 0:
            if symbol[p] == c:
                q = target[p]
                break
            if symbol[p] < 0:
                symbol[p], target[p] = c, new
            else:
                ways = more.setdefault(p, {})
                if c in ways:
                    q = ways[c]
                    break
                ways[c] = new
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                symbol.append(symbol[q]), target.append(target[q]), link.append(link[q]), length.append(length[p] + 1), first.append(first[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if symbol[p] == c:
                        if target[p] != q:
                            break
                        target[p] = twin
                    elif more.get(p, {}).get(c) == q:
                        more[p][c] = twin
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, i, n = [], 0, len(s)
    while i < n:
        v, j = 0, i
        while j < n:
            c = s[j]
            w = target[v] if symbol[v] == c else more[v].get(c, -1) if v in more else -1
            if w < 0 or first[w] >= j:
                break
            v, j = w, j + 1
        out.append((i, max(j - i, 1), first[v] - (j - i) + 1 if j > i else -1))
        i = max(j, i + 1)
    return out


def common(s: list[int], stop: int) -> list[int]:
    """For each place before ``stop``: how far ``s`` from there agrees with ``s`` from its begin; 0 for place 0."""
    n, z, lo, hi = len(s), [0] * min(stop, len(s)), 0, 0
    for i in range(1, len(z)):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def touching(s: list[int], before: int, b: int, right: int, power: int, least: int) -> dict[tuple[int, int], int]:
    """Runs (begin, end) -> period that touch place ``b`` and end in ``s[b:right]`` or at b; ``before``: length of the factor that ends at b."""
    longest = (before + right - b - 1) // (power - 1)
    found: dict[tuple[int, int], int] = {}
    if longest < 1:
        return found
    left = max(0, b - before - longest)
    t, u = s[left:b], s[b:right]
    back = t[::-1]
    near = u[:longest]
    ahead = common(u, longest + 1)
    behind = common(back, longest + 1)
    over = common(back + [-1] + near[::-1] + back, len(t) + 1 + len(near))
    back_near = t[-longest:]
    under = common(u + [-1] + back_near + u, len(u) + 1 + len(back_near))
    n = len(s)

    def keep(begin: int, end: int, p: int) -> None:
        if end - begin < max(least, power * p) or (begin, end) in found:
            return
        if (end < n and s[end] == s[end - p]) or (begin and s[begin - 1] == s[begin - 1 + p]):
            return  # cut by the window: it ends at another boundary, whose window holds it
        found[begin, end] = p

    for p in range(1, longest + 1):  # smallest periods first, so that multiples of one are known
        if p <= len(near):
            keep(b - over[len(t) + 1 + len(near) - p], b + p + (ahead[p] if p < len(u) else 0), p)
        if p <= len(t):
            keep(b - p - (behind[p] if p < len(t) else 0), b + under[len(u) + 1 + len(back_near) - p], p)
    return found


def maximal_runs(s: list[int], power: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(begin, end, period) of all runs of at least ``power`` >= 2 periods and ``least`` symbols, ordered."""
    cut = factors(s)
    runs: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    before = 0
    for b, size, source in [*cut, (len(s), 0, -1)]:
        if before:
            for (begin, end), p in touching(s, before, b, b + size, power, least).items():
                if (begin, end) not in known:
                    known.add((begin, end))
                    insort(runs, (begin, end, p))
        if source >= 0:
            # ascending, so that where a factor overlaps its source its own copies are copied on
            at, way = bisect_right(runs, (source + 1,)), b - source
            while at < len(runs) and runs[at][0] < source + size:
                begin, end, p = runs[at]
                if end < source + size and (begin + way, end + way) not in known:
                    known.add((begin + way, end + way))
                    insort(runs, (begin + way, end + way, p))
                at += 1
        before = size
    return runs


def stretches(s: np.ndarray, power: int, least: int) -> list[tuple[int, int]]:
    """Stretches (begin, end) outside which no run can be.

    In a run of four periods and six symbols every three neighbours occur at
    least three times.  Triples are counted by a hash; a collision only widens.
    """
    if len(s) < least:
        return []
    if power < 4 or least < 6:
        return [(0, len(s))]
    x = s.astype(np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    triple = ((x[:-2] * k + x[1:-1]) ^ (x[1:-1] >> np.uint64(7))) * k + x[2:]
    _, which, count = np.unique(triple, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], count[which] >= 3, [False]])
    edge = np.flatnonzero(often[1:] != often[:-1])
    return [(int(i), int(j) + 2) for i, j in zip(edge[::2], edge[1::2], strict=True) if j + 2 - i >= least]


def runs_of(s: np.ndarray, power: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """``maximal_runs`` of the stretches that can hold one; each run lies in one stretch, whole."""
    return [(i + a, i + b, p) for i, j in stretches(s, power, least) for a, b, p in maximal_runs(s[i:j].tolist(), power, least)]
