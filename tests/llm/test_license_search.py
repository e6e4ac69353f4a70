"""License search against exact containment over all runs of words; whole texts against their siblings."""

from __future__ import annotations

import random
import re

from gaugeworks.llm import license_scan, license_texts


def runs(text: str) -> list[tuple[str, ...]]:
    w = re.findall(r"[a-z0-9]+", text.lower())
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def held(text: list, template: set, width: int) -> float:
    """Largest share of the template in any run of ``width`` shingles."""
    count, seen, best = {}, 0, 0
    for k, s in enumerate(text):
        if s in template:
            count[s] = count.get(s, 0) + 1
            seen += count[s] == 1
        if k >= width and text[k - width] in template:
            old = text[k - width]
            count[old] -= 1
            seen -= count[old] == 0
        best = max(best, seen)
    return best / len(template)


def test_no_template_with_enough_in_one_place_is_missed(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    known = [(f"T{k}", " ".join(rng.choices(words, k=n))) for k, n in enumerate((5, 6, 9, 14, 23, 40, 66, 105, 160, 240) * 3)]
    docs = []
    for k in range(400):
        text = rng.choices(words, k=rng.randrange(400))
        for _ in range(rng.randrange(3)):
            t = rng.choice(known)[1].split()
            rate = rng.choice((0, 0.01, 0.02, 0.04))
            t = [rng.choice(words) if rng.random() < rate else w for w in t][rng.choice((0, 0, 1, 3)) :]
            at = rng.randrange(len(text) + 1)
            text[at:at] = t
        docs.append((k, " ".join(text)))
    docs += [(400, known[9][1] + " x" * 30_000 + " " + known[8][1]), (401, None), (402, ""), (403, known[0][1]), (403, known[0][1])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")
    rows = license_scan.licenses(frame, known).collect()
    got = {(r.doc_id, r.license) for r in rows}
    sure, possible = set(), set()
    for i, t in docs:
        text = runs(t or "")
        for name, template in known:
            want = set(runs(template))
            if want and held(text, want, 1 << (len(want) - 1).bit_length()) >= 0.8:
                sure.add((i, name))
            if want and held(text, want, len(text) or 1) >= 0.8:
                possible.add((i, name))
    assert len(sure) > 200 and sure <= got <= possible  # recall 1.0
    assert sum(r.doc_id == 403 for r in rows) == 2
    assert license_scan.licenses(frame.limit(0), known).count() == 0


def test_whole_texts_are_told_from_their_siblings(spark):
    texts = [(k, t) for k, every in license_texts.TEXTS.items() for t in every]
    docs = spark.createDataFrame([(i, f"aa bb cc dd ee ff {t} gg hh ii jj kk") for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license) for r in license_scan.licenses(docs).collect())
    assert got == [(i, k) for i, (k, _) in enumerate(texts)]
