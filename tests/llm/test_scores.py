"""Search of benchmark items and licenses, archives, classifiers and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random

import compare
import numpy as np
import pytest

import corpus_pipeline
from gaugeworks.llm import decontaminate, langid, license_scan, queries, toxicity, trees, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = compare.connect(FOLDER)
    assert compare.difference(spark, con, queries.queries()[name], queries.oracle_sql()[name], FOLDER) is None


def test_items_inside_long_documents(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(4000)]

    def some(n):
        return " ".join(rng.choices(words, k=n))

    items = [(k, some(n)) for k, n in enumerate((12, 30, 80, 200, 5, 4))] + [(90, None), (91, ""), (None, some(20))]
    broken = items[2][1].split()
    broken[40] = "other"
    docs = [(k, f"{some(3000)}. {items[k][1].upper()}, {some(2000)}") for k in range(6)] + [(10, some(100) + " " + " ".join(broken)), (11, " ".join(items[3][1].split()[:150])), (12, None), (13, ""), (0, some(10)), (None, items[1][1])]
    d = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, n_item int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (10, 2)]
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
    left = decontaminate.without_contaminated(d, decontaminate.contaminated(d, b))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["5", "11", "12", "13", "None"])


def test_license_statements(spark):
    docs = [(1, "xx " * 300 + "Licensed under the Apache License, Version 2.0. " + "yy " * 100), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "nothing of the kind"), (4, None), (5, ""), (6, "RELEASED UNDER THE MIT LICENSE!"), (7, license_scan.NOTICES["ISC"][0].replace("hereby ", "") + " zz" * 40)]
    got = {(r.doc_id, r.license) for r in license_scan.licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"), (2, "GPL-3.0"), (6, "MIT"), (7, "ISC")}
    assert license_scan.licenses(spark.createDataFrame(docs, "doc_id long, text string"), known=[]).count() == 0


def test_archives(spark):
    pages = [(1, "http://a", "same", 0), (2, None, "same", 0), (3, "http://c", None, 0), (4, "u", "", 0), (5, "u\r\nX: y", "é" * 1000, 0), (None, "u", "same", 0), (2, None, "same", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, owner int")
    every = warc.round_trip(df).collect()
    assert len(every) == 6  # a record for each row with an id
    assert sorted((r.record_type, r.refers_to) for r in every if r.page_id == 2) == [("response", None), ("revisit", 2)]
    got = {r.page_id: r for r in every if (r.page_id, r.record_type) != (2, "revisit")}
    want = {i: (h or "").encode() for i, _, h, _ in pages if i is not None}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode()) for i, h in want.items()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert warc.round_trip(df.limit(0)).count() == 0
    few = warc.round_trip(df, least_bytes=10).collect()
    assert {r.record_type for r in few} == {"response"} and len(few) == 6


def test_repeated_rows_are_revisits(spark):
    """Of many equal rows one record holds the payload; rows of one id with unlike payloads are kept apart."""
    pages = [(1, "u", "aa")] * 3 + [(1, "u", "bb"), (0, "u", "aa"), (0, "v", "aa"), (3, "u", "cc")]
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or -1) for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect())
    assert got == sorted([(1, 2, "response", -1), (1, 2, "revisit", 1), (1, 2, "revisit", 1), (1, 2, "response", -1), (0, 2, "revisit", 1), (0, 2, "revisit", 1), (3, 2, "response", -1)])


def test_records_are_frames_of_their_own():
    made = [warc.record(k, "u", (f"<p>{k}</p>" * 50).encode(), "D", None) for k in range(300)]
    data = warc.archive(made)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(data) < sum(map(len, made))
    assert [h["WARC-Record-ID"] for h, _ in warc.records(data)] == [f"<urn:page:{k}>" for k in range(300)]


def test_languages(spark):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()}
    known = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(known) and np.mean([got[i].lang_pred == known[i] for i in held]) > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !!", None), (None, "the of and", "en"), (4, "x" * 5000, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(odd).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and len(out) == 5
    assert langid.languages(odd.limit(0)).count() == 0


def test_filter_values_are_sums_of_tables():
    rng = np.random.default_rng(0)
    net = langid.fit(rng.integers(97, 123, (40, langid.WINDOW)).astype(np.uint8), np.arange(40) % 2, ["a", "b"], passes=1)
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    e = net.embed[x]
    want = []
    for width, w in zip(langid.WIDTHS, net.filters, strict=True):
        z = np.stack([e[:, k : k + width].reshape(3, -1) @ w for k in range(langid.WINDOW - width + 1)], axis=1)
        want.append(z.max(axis=1))
    assert np.allclose(langid.pooled(x, net.tables(), net.bias), np.maximum(np.concatenate(want, axis=1) + net.bias, 0), atol=1e-3)


def test_toxicity(spark):
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    caught = sum(got[i].predicted and labels[i] for i in held)
    assert caught / sum(labels[i] for i in held) > 0.9 and caught / sum(got[i].predicted for i in held) > 0.9
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you IDIOT " * 2000), (None, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (3, 1), (3, None), (9, 5)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, ones).collect()} == {1.0}
    assert toxicity.toxicity(docs.limit(0), ones).count() == 0


def test_isotonic_pools_violators():
    x, y = trees.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and np.isclose(np.interp(3, x, y), 0.5)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != "best_fit":
            assert docs.columns == columns and docs.count() <= before
    out = corpus_pipeline.run(spark, FOLDER)
    assert 0 < out.select("doc_id").distinct().count() <= before
