"""Token ids against the library, the coder against its input, packing against its rules."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import packing, simple8b, token_files, tokens

ODD = st.text(alphabet="abcXYZ's't'rELLdm019 \t\n.,-_<|>#é ÉßŸſİıŉ ΣσςΑ日½² ́̇\x1c\x85🎉ﬁ", max_size=50)


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), ODD, st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "Don't it's"])), max_size=6))
def test_ids_are_the_librarys(texts):
    e = tokens.encoder(tokens.vocabulary_path())
    ids, rows = e.encode(pa.array(["zz", *texts], pa.string()).slice(1))
    for i, t in enumerate(texts):
        assert ids[rows[i] : rows[i + 1]].tolist() == e.whole.encode(t or "", add_special_tokens=False).ids


def test_memory_grows_and_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n, n + 60)) for n in range(0, 240, 30)]
    for t in texts:
        ids, _ = encoder.encode(pa.array([t]))
        assert ids.tolist() == encoder.whole.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=600))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    assert (simple8b.decode(*simple8b.encode(v), len(v)) == v).all()


def test_simple8b_many_blocks_with_escapes():
    v = np.random.default_rng(1).integers(0, 50000, 700_001).astype(np.uint64)
    v[::100_000] = np.uint64(2**63 + 5)
    assert (simple8b.decode(*simple8b.encode(v), len(v)) == v).all()


def test_token_file_refuses_other_bytes():
    with pytest.raises(ValueError, match="token file"):
        token_files.unpacked(b"x" * 100)


DOCS = [(5, "Hello world", "x"), (2, None, "x"), (9, "", None), (7, "a " * 9000, "x"), (None, "no id", "x"), (5, "Hello world", "x")]
SCHEMA = "doc_id long, text string, start string"  # a column whose name clashes with the result


def test_files_hold_every_document(spark, encoder):
    got = token_files.round_trip(spark.createDataFrame(DOCS, SCHEMA)).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted((d[0], d[1] or "") for d in DOCS if d[0] is not None), strict=True):
        ids = [*encoder.whole.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_files.round_trip(none).count() == 0
    assert packing.packed(none).count() == 0


def test_packing_rules(spark, encoder):
    rng = np.random.default_rng(0)
    docs = [(int(i), "a " * int(n)) for i, n in enumerate(rng.integers(1, 5000, 300))] + [(1000, None), (1001, "")]
    got = packing.packed(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(encoder.whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in docs}
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert (got[got.piece > 0].start % 4096 == 0).all()
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 4096) + 1


def test_items_that_do_not_fit_together_end_the_rounds(spark):
    docs = spark.createDataFrame([(i, "a " * 2500) for i in range(40)], "doc_id long, text string")
    assert packing.packed(docs).select("sequence_id").distinct().count() == 40


def test_best_fit_takes_the_fullest_sequence():
    assert packing.best_fit(np.array([6, 5, 4, 5]), 10) == [[0, 2], [1, 3]]
