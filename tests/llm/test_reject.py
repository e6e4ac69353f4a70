"""Texts in no learned language are refused; clean and mixed ones stay."""

from __future__ import annotations

import base64
import random

import pytest

import corpus_pipeline
from gaugeworks.llm import langid

FOLDER = "/root/testdata/sf0.01"
CODE = "def run(batches):\n    for whole in batches:\n        yield pa.RecordBatch.from_arrays([part.column(name)], names=names)\n"


@pytest.mark.parametrize("learned", [["de", "en", "es", "fr"], ["de", "en", "es"], ["en", "es"], ["en"]])
def test_language_stage_refuses_what_is_not_learned(spark, learned):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r for r in docs.where("length(text) > 200").orderBy("doc_id").collect()]
    by = {k: [r.text for r in rows if r.lang == k] for k in ("de", "en", "es", "fr")}
    letters = "abcdefghijklmnopqrstuvwxyz    "
    junk = ["".join(rng.choices(letters, k=n)) for n in (60, 300, 5000)]
    junk += ["".join(rng.sample(t, len(t))) for t in by["en"][:5]] + [base64.b64encode(rng.randbytes(400)).decode(), CODE * 3]
    junk += [t for k, texts in by.items() if k not in learned for t in texts[:10]]
    a, b = by[learned[0]], by[learned[-1]]
    mixed = [f"{x[:400]} {y[:400]}" for x, y in zip(a[:10], b[10:20], strict=True)]
    mixed += [" ".join(w for pair in zip(x.split(), y.split()) for w in pair) for x, y in zip(a[:10], b[10:20], strict=True)]
    made = [(10**6 + k, t) for k, t in enumerate(junk)] + [(2 * 10**6 + k, t) for k, t in enumerate(mixed)]
    columns = docs.columns
    extra = spark.createDataFrame([tuple({"doc_id": i, "text": t, "lang": None, "source": "made", "n_chars": len(t)}[c] for c in columns) for i, t in made], docs.schema)
    known = docs.where(docs["lang"].isin(learned))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, known.unionByName(extra), FOLDER).select("doc_id").collect()}
    assert not [i for i in kept if 10**6 <= i < 2 * 10**6]
    assert {2 * 10**6 + k for k in range(len(mixed))} <= kept
    clean = {r.doc_id for r in known.select("doc_id").collect()}
    assert len(clean - kept) <= len(clean) // 500


def test_languages_of_few_documents_are_not_judged(spark):
    rows = [(k, "some words of a language that hardly occurs", "xx") for k in range(3)] + [(9, "Русский язык", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identified(df, langid.train(df), refuse=True).collect()} <= {"xx", "und"}
    net = langid.train(df)
    assert net is None or not net.usual.judged.any()
