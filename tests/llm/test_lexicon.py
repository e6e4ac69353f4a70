"""The learned lexicon keeps every entry that passes its test."""

from __future__ import annotations

import pyarrow as pa

from gaugeworks.llm import toxicity
from gaugeworks.llm.words import Words


def test_rare_entries_stay_however_many_pass(spark):
    common = " ".join(f"often{k}" for k in range(4500))
    rows = [(f"{common} {'rareword' if k < 3 else ''}", 1) for k in range(6)] + [("plain text", 0)] * 400
    found = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"), 6, 400)
    wanted = Words(pa.array([common + " rareword"])).hashes
    assert len(found.keys) > 4500 and set(wanted) <= set(found.keys)


def test_what_is_learned_from_is_bounded_by_bytes(spark, monkeypatch):
    """Beyond the bound a part of the labelled documents is counted, and the trees are fitted on a part of that part."""
    docs = spark.createDataFrame([(k, f"you {'vile' if k % 3 == 0 else 'kind'} person number {k}") for k in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(900)], "doc_id long, toxic int")
    counted = []
    learned = toxicity.lexicon
    monkeypatch.setattr(toxicity, "lexicon", lambda rows, t, c: (counted.append((rows.count(), t + c)), learned(rows, t, c))[1])
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "LEARN_BYTES", 8000)
    part = toxicity.train(docs, labels)
    assert counted[0][0] == counted[0][1] > 600 and 150 < counted[1][0] == counted[1][1] < 450
    for model in (whole, part):
        got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
        assert min(got[k] for k in range(0, 900, 3)) > 0.5 > max(got[k] for k in range(900) if k % 3)
