"""Spelling variants against comparing all words with all."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from gaugeworks.llm import spelling
from gaugeworks.llm.store import Scratch


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_words(rows, letters=6, spoil=199):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                n[run] += 1
    return n


def plain(words, times=5):
    out = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best and words[best] >= times * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {(w, *v) for w, v in out.items()}


def vocabulary(seed, size, letters, sizes):
    rng = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*sizes)))
        words.add(w)
        for _ in range(rng.randint(0, 2)):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind < 2) :]
            words.add(w)
    return {w: rng.choice([5, 6, 20, 30, 140, 900, 5000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize(("few", "blocks"), [(0, 1), (8, 1), (0, 3)])
def test_a_list_gives_the_pairs_of_its_words(monkeypatch, few, blocks):
    """Merged by the heap or verified at once, within a block or between blocks."""
    monkeypatch.setattr(spelling, "FEW", few)
    rng = random.Random(few)
    for longer in (6, 7, 9, 12):
        q, at = spelling.gram_size(longer), 1
        for _ in range(60):
            words = {}
            for _ in range(rng.randint(2, 30)):
                size = rng.choice([longer, longer, longer - 1])
                w = "".join(rng.choice("ab") for _ in range(size))
                words[w[:at] + "b" * q + w[at + q :]] = rng.randrange(blocks)
            got = list(spelling.linked(longer, ("b" * q, at), list(words.items()), blocks > 1))
            expected = {(x, y) for x in words for y in words if x < y and near(x, y) and longer in (len(x), len(y)) and (blocks == 1 or words[x] != words[y])}
            assert set(got) == expected and len(got) == len(expected)


@pytest.mark.parametrize(("seed", "letters", "sizes", "block"), [(1, "ab", (6, 9), 2000), (2, "ab", (6, 8), 16), (3, "aeinrstéÿ", (6, 13), 2000), (4, "abc", (20, 30), 7), (5, "a", (6, 40), 3)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, seed, letters, sizes, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = vocabulary(seed, min(450, 30 if letters == "a" else 450, 2 ** sizes[1]), letters, sizes)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain(words)


def test_one_edit():
    rng = random.Random(7)
    for _ in range(20_000):
        x, y = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert spelling.one_edit(x, y) == near(x, y), (x, y)


def test_words_are_spoiled_by_the_rule(spark):
    rng = random.Random(3)
    lexicon = ["harvest", "HARVEST", "windowés", "WindÖws", "ÀÀÀÀÀÀ", "short", "candle", "candles", "x1candle2y", "bācandle"]
    rows = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(None, "harvest"), (7, None), (8, ""), (9, "harvest " * 9), (9, "harvest " * 9), (10, "a" * 50_000), (11, "candle-" * 30_000)]
    docs = spark.createDataFrame([(*r, 3, "w") for r in rows], "doc_id long, text string, n int, word string").repartition(4)
    expected = plain_words(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs, spoil=199).collect()} == expected
    assert any(len(w) == 6 and w not in ("candle",) and w in "harvest" for w in expected) or any(near("candles", w) for w in expected)
    got = spelling.spelling_variants(docs, spoil=199)
    assert {tuple(r) for r in got.collect()} == plain({w: n for w, n in expected.items() if n >= 5})
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chains_are_followed_to_the_last_form(spark):
    words = {"abcdefg": 10**6, "abcdefx": 10**5, "abcdexx": 10**4, "abcdxxx": 1000, "abcxxxx": 100, "abxxxxx": 10, "axxxxxx": 9}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["abxxxxx"].root == "abcdefg" and got["abxxxxx"].form == "abcxxxx" and got["axxxxxx"].form is None and got["axxxxxx"].n_near == 1
    with pytest.raises(ValueError, match="twice"):
        spelling.variants(spark.createDataFrame([("abcdef", 1)], "word string, n long"), times=1)


def test_footer_words_make_no_pairs(spark):
    """Words that share a long common part meet under their rare grams, not under the common one."""
    rng = random.Random(4)
    words = sorted({"aaaaaaaa" + "".join(rng.choice("bcdefghijklmnop") for _ in range(6)) for _ in range(600)})
    scratch = Scratch(spark, "footer")
    pairs = spelling.near_words(scratch.table(spark.createDataFrame([(w,) for w in words], "word string"), "w"), scratch)
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
