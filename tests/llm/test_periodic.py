"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from gaugeworks.llm import periodic
from gaugeworks.llm.runs import factors, maximal_runs, runs_of


def plain(s, power, least):
    found = {}
    for p in range(1, len(s) // power + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, power * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b, p) for (a, b), p in found.items())


def sequences(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        size, kinds = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(kinds) for _ in range(size)]
        for _ in range(rng.randint(0, 3) if size > 8 else 0):
            a, p = rng.randrange(size), rng.randint(1, 6)
            for i in range(a + p, min(size, a + p * rng.randint(3, 8))):
                s[i] = s[i - p]
        yield s


@pytest.mark.parametrize(("power", "least"), [(4, 6), (3, 4), (2, 2)])
def test_runs_are_those_of_a_plain_search(power, least):
    for s in sequences(2500, power):
        assert maximal_runs(s, power, least) == plain(s, power, least), s
        assert runs_of(np.array(s, dtype=np.int64), power, least) == plain(s, power, least), s


def test_factors_are_the_longest_that_begin_earlier():
    for s in sequences(400, 9):
        at = 0
        for b, size, source in factors(s):
            assert b == at
            earlier = [k for k in range(b) if s[k : k + size] == s[b : b + size]]
            assert (source in earlier) if source >= 0 else (size == 1 and s[b] not in s[:b])
            assert b + size == len(s) or source < 0 or not any(s[k : k + size + 1] == s[b : b + size + 1] for k in range(b))
            at += size
        assert at == len(s)


def test_long_sequences_stay_linear():
    rng = random.Random(5)
    unit = [rng.randrange(1000) for _ in range(10_000)]
    assert maximal_runs([7] * 100_000) == [(0, 100_000, 1)]
    assert maximal_runs(unit * 5 + [1001]) == [(0, 50_000, 10_000)]


def expected(doc_id, text):
    """The contract's columns, word by word."""
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted((a, b - a, p) for a, b, p in plain(w, 4, 6))
    gone = {i for a, size, p in runs for i in range(a + p, a + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{size},{p}\n" for a, size, p in runs)
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_query_is_the_contract(spark):
    rng = random.Random(2)
    texts = [None, "", " \t ", "a a a a a", "a a a a a a", "x a b a b a b a b y", "é é é é é é  é\n  é", "A a A a A a A a", "a\x00b " * 7, "spam eggs " * 3000 + "end"]
    texts += [" ".join(str(x) for x in s) for s in sequences(150, 11)]
    rows = [(i if i != 40 else None, t) for i, t in enumerate(texts)] + [(5, "again"), (5, texts[5])]
    rows += [(i, " ".join(rng.choice("abcdefgh") for _ in range(50))) for i in range(1000, 1100)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, rest string").repartition(3)
    got = periodic.digests(periodic.repeated_runs(periodic.with_repeating_tails(docs))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10


def test_rest_keeps_each_first_period(spark):
    docs = spark.createDataFrame([(1, "x  a b a b a b a b\ta y"), (2, "k k k k k k k z")], "doc_id int, text string")
    got = {r.doc_id: (r.rest, [tuple(x) for x in r.runs]) for r in periodic.repeated_runs(docs).collect()}
    assert got == {1: ("x a b y", [(1, 9, 2)]), 2: ("k z", [(0, 7, 1)])}
    assert periodic.repeated_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.repeated_runs(docs, power=1)
