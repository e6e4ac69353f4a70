"""Direct identifiers against the patterns as they stand; disclosing terms against plain counts over documents."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from gaugeworks.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


CASES = [
    "", "a@b.c@d.ef", "x@y", "@b.com a@.com a@b..com a..b@c.d", "é@b.com ü.a@b-c.d.e. x", "a@b.com@c.de,f@g.hi",
    "1.2.3.4.5.6.7.8 999.1.1.1.1 0255.000.00001.2 256.1.1.1 1.2.3", "12345678901234567890.1.1.1", "4111 1111-1111 1111 4111111111111111 4111111111111112",
    "4111111111111111 1", "4111--111111111111", "+1 (555) 123-4567 +12 +1234567 +(1)23456789 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 ++49 30 1234567.",
    "+1 (555) 010-2222 4111 1111 1111 1111 and 10.0.0.1:80/a@b.co", "١٢.1.2.3.4 \U0001f600 a@b.com", "+1555\n0102222",
]


def test_entities_are_the_patterns():
    rng = random.Random(1)
    alphabet = list("aB0123456789...@@@+-- ()%_é\n4")
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    digits = list("0123456789012345678901234567890 -.+")
    texts += ["".join(rng.choice(digits) for _ in range(rng.randint(10, 80))) for _ in range(6000)]
    seen = set()
    for t in texts:
        got = [s[:3] for s in pii.entities(t)]
        assert got == plain(t), t
        seen.update(k for k, _, _ in got)
    assert seen == set(PATTERNS)


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" * 100_000, "1 " * 150_000, "a.b" * 100_000 + "@"):
        pii.entities(t)
    crowded = ",".join(f"a{i}@b.com" for i in range(3000))
    assert len(pii.contexts(crowded, pii.entities(crowded), 8)) == 3000


def corpus():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sa") for b in ("ber", "dan", "fel", "gor", "hal", "jim", "kos", "lup")]
    rows = []
    for i in range(300):
        body = [rng.choice(words) for _ in range(30)]
        at = rng.randrange(30)
        if i % 15 == 0:  # a nickname and a badge number that stand near one address only
            body[at:at] = ["(Zorgluk),", "ann.lee@corp.example", "badge7781"]
        elif i % 15 == 1:  # a word found everywhere is no evidence
            body[at:at] = ["kaber", "+1 555 010 2233"]
        elif i % 100 == 2:
            body[at:at] = ["zorgluk"]
        rows.append((i, " ".join(body)))
    copied = "qqfirst qqsecond bob@x.example qqthird"
    rows += [(400 + i, copied) for i in range(20)]
    rows += [(500, None), (501, ""), (0, rows[0][1]), (502, "Zorgluk: zorgluk@a.bc zorgluk" + " filler" * 20_000)]
    return rows


def disclosing(rows, window, share):
    """(terms, classes that disclose) by plain counting."""
    term = lambda w: re.sub("[A-Z]", lambda m: m.group().lower(), w.strip(pii.EDGE))
    have = defaultdict(set)
    near = defaultdict(lambda: (set(), set()))
    owners = defaultdict(set)
    for row, (_, text) in enumerate(rows):
        text = text or ""
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        for _, _, w in words:
            if t := term(w):
                have[t].add(row)
                have["class", pii.class_of(t)].add(row)
        spans = plain(text)
        values = {s[:3]: s[3] for s in pii.entities(text)}
        free = [w for w in words if not any(w[0] < b and a < w[1] for _, a, b in spans)]
        for s in spans:
            entity = s[0], values[s]
            owners[entity].add(row)
            before, after = [w for w in free if w[1] <= s[1]][-window:], [w for w in free if w[0] >= s[2]][:window]
            terms = [t for w in before + after if (t := term(w[2]))]
            for t in [*terms, *[("class", pii.class_of(t)) for t in terms]]:
                docs, contexts = near[entity, t]
                docs.add(row)
                contexts.add(tuple(terms))

    def discloses(entity, t):
        docs, contexts = near[entity, t] if (entity, t) in near else ((), ())
        if len(docs) < 2 or len(contexts) < 2:
            return None
        n, c = len(rows), len(owners[entity])
        return math.log2(n / c) > 0 and math.log2(n * len(docs) / (c * len(have[t]))) >= share * math.log2(n / c) - 1e-9

    told = defaultdict(list)
    for entity, t in list(near):
        if isinstance(t, str) and discloses(entity, t):
            told[t].append(entity)
    return {t: None if any(discloses(e, ("class", pii.class_of(t))) is not False for e in es) else pii.class_of(t) for t, es in told.items()}


def test_terms_are_those_of_plain_counts(spark):
    rows = corpus()
    expected = disclosing(rows, 8, 0.9)
    assert "zorgluk" in expected and "badge7781" in expected and "kaber" not in expected and "qqfirst" not in expected
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, term string, row_key int").repartition(5)
    found = pii.personal_data(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append(r.spans)
    for i, text in rows:
        spans = got[i][0]
        assert all(s == spans for s in got[i])
        assert [tuple(s)[:3] for s in spans if s.kind != "term"] == plain(text)
        taken = plain(text)
        terms = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
            w = m.group()
            a, b = m.end() - len(w.lstrip(pii.EDGE)), m.start() + len(w.rstrip(pii.EDGE))
            if pii.term_of(w) in expected and not any(x < b and a < y for _, x, y in taken):
                terms.append(("term", a, b, expected[pii.term_of(w)]))
        assert [tuple(s) for s in spans if s.kind == "term"] == terms
    assert len(got[0]) == 2 and got[500] == [[]] and len(got) == len({i for i, _ in rows})
    clean = {i: t for i, t in ((r.doc_id, r.text) for r in pii.sanitised(docs, found).collect())}
    assert "zorgluk" not in clean[0].lower() and "[email]" in clean[0] and clean[500] is None and clean[501] == ""
    assert "zorgluk" not in clean[2].lower() and clean[102].count("zorgluk") == 0
    assert clean[1] == dict(rows)[1].replace("+1 555 010 2233", "[phone]")
    n = {r.doc_id: r for r in pii.digests(found).collect()}
    assert n[0].n_email == 1 and n[0].n_term == 2 and n[500].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert n[1].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(dict(rows)[1]))
    assert n[1].base_sha256 == hashlib.sha256(n[1].spans.encode()).hexdigest()


def test_general_forms_need_a_class_that_tells_less(spark):
    """A word whose first letters are common is generalised; one whose class is its own goes."""
    rows = [(i, f"kappa{'x' * (i % 3)} {'kaplan' if i < 4 else 'filler'} {'eve@b.example' if i < 4 else ''} note{i}") for i in range(60)]
    terms = {}
    for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for s in r.spans:
            if s.kind == "term":
                terms[dict(rows)[r.doc_id][s.start : s.end]] = s.form
    assert terms == {"kaplan": "ka*"}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "nothing here")]])
def test_empty_tables(spark, rows):
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_id, r.spans) for r in found.collect()] == [(i, []) for i, _ in rows]
