"""Duplicate searches against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gaugeworks.llm import embed_dedup, near_dedup, suffix_dedup
from gaugeworks.llm.components import components
from gaugeworks.llm.store import Scratch


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    links += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    u = Union({x for p in links for x in p})
    for a, b in links:
        u.join(a, b)
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in linked}


def family(rng, base, n, most):
    """Copies of a text with a random share of words replaced."""
    for _ in range(n):
        w, p = base.split(), rng.random() * most
        yield " ".join(rng.choice(("x", "y", "z")) + str(rng.randrange(10**6)) if rng.random() < p else x for x in w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.choice((3, 8, 60, 150)))) for _ in range(80)]
    for b in list(texts[:6]):
        texts += list(family(rng, b, 25, 0.12))
        texts += [" ".join(b.split()[: rng.randrange(2, 160)]) for _ in range(6)]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t "), None, "", "   ", "one two", "One  two", "one two three", texts[3], texts[3]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_near_duplicates_match_brute_force(spark, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    u = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                u.join(a, b)
    docs = spark.createDataFrame([(i, t, 7) for i, t in corpus], "doc_id long, text string, rep int")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), u.find(i), u.find(i) == i) for i, s in sets.items()}


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in near_dedup.near_duplicates(rows).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 170, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 15, dtype=np.uint64)])) for _ in range(2)]
    sig = near_dedup.densified(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 2048)
    assert abs((sig[0] == sig[1]).mean() - 170 / 200) < 0.05


def covered(texts, length=50):
    """Word places that stay and that go, by brute force over all windows."""
    seen, gone, first = {}, {}, {}
    words = {i: (t or "").encode().lower().split() for i, t in texts}
    occ = {}
    for i in sorted(words):
        for p in range(len(words[i]) - length + 1):
            occ.setdefault(tuple(words[i][p : p + length]), []).append((i, p))
    for places in occ.values():
        if len(places) > 1:
            f = places[0]
            for i, p in places:
                seen.setdefault(i, set()).update(range(p, p + length))
                if (i, p) != f:
                    gone.setdefault(i, set()).update(range(max(p, f[1] + length) if f[0] == i else p, p + length))
    return words, seen, {i: s for i, s in gone.items() if s}, first


def test_repeated_spans_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]

    def some(n):
        return " ".join(rng.choices(words, k=n))

    passages = [some(n) for n in (50, 51, 75, 120, 49)]
    texts = [(k, " ".join([some(rng.randrange(30)), rng.choice(passages), some(rng.randrange(60)), rng.choice(passages), some(rng.randrange(9))])) for k in range(60)]
    texts += [(100, "la " * 170), (101, None), (102, ""), (103, some(10)), (104, texts[0][1]), (105, texts[0][1].upper()), (106, passages[0]), (107, "é " + passages[3] + " ü")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, place string")
    spans = suffix_dedup.repeated_spans(docs)
    all_words, seen, gone, _ = covered(texts)
    got_seen, got_gone = {}, {}
    for r in spans.collect():
        got_seen.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        if r.removed:
            got_gone.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert (got_seen, got_gone) == (seen, gone)
    left = {r.doc_id: (r.text or "").encode().lower().split() for r in suffix_dedup.without_repeats(docs, spans).collect()}
    assert {i: left.get(i, []) for i in all_words} == {i: [w for k, w in enumerate(ws) if k not in gone.get(i, ())] for i, ws in all_words.items()}
    assert 101 in left and 102 in left and 104 not in left


def test_repeated_spans_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    spans = suffix_dedup.repeated_spans(none)
    assert spans.count() == 0 and suffix_dedup.without_repeats(none, spans).count() == 0


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    rows = [b + rng.normal(size=64) * rng.choice((0.0, 0.1, 0.3)) for b in base for _ in range(4)]
    table = [(k, [float(x) for x in v], int(k // 4 % 3)) for k, v in enumerate(np.float32(rows))]
    table += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] + [1.0] * 63, 1), (1003, [], 1), (1004, table[0][1], None), (1005, table[0][1][:32], 0), (1006, [1e30] + [0.0] * 63, 2), (1007, [2e30] + [0.0] * 63, 2), (1008, [None] + [1.0] * 63, 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    fine = {i: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for i, v, y in table if v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    labels = {i: y for i, _, y in table}
    u, n = Union(labels), dict.fromkeys(labels, 0)
    for a in fine:
        for b in fine:
            if a < b and labels[a] == labels[b] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.93:
                u.join(a, b)
                n[a] += 1
                n[b] += 1
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], u.find(i), u.find(i) == i) for i in labels}
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0
