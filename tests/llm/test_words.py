"""Word hashes and shingles against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm.words import Words, distinct_sorted, slices

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é\t\n\x0b,日" + "\x1c", max_size=40)), max_size=8)


def words(t: str | None) -> list[bytes]:
    return (t or "").encode().lower().split()


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_and_shingles(texts):
    w = Words(pa.array(["", *texts], pa.string()).slice(1))  # an offset, as batches have
    want = [words(t) for t in texts]
    assert np.diff(w.rows).tolist() == [len(x) for x in want]
    by_word: dict = {}
    for h, x in zip(w.hashes.tolist(), [x for r in want for x in r], strict=True):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)
    for width in (2, 5, 12):
        hashes, rows = w.shingles(width)
        seen: dict = {}
        for i, r in enumerate(want):
            grams = [tuple(r[k : k + width]) for k in range(len(r) - width + 1)] or ([tuple(r)] if r else [])
            own = hashes[rows[i] : rows[i + 1]].tolist()
            assert len(own) == len(grams)
            for g, h in zip(grams, own, strict=True):
                assert seen.setdefault(g, h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_words_differ():
    w = Words(pa.array(["a" * 100, "a" * 99 + "b", "a" * 100]))
    assert w.hashes[0] == w.hashes[2] != w.hashes[1]


def test_distinct_sorted():
    v, rows = distinct_sorted(np.array([3, 1, 3, 2], dtype=np.uint64), np.array([0, 3, 3, 4]))
    assert v.tolist() == [1, 3, 2] and rows.tolist() == [0, 2, 2, 3]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 1000, "", "z"])], names=["text"])
    assert sum((p.column(0).to_pylist() for p in slices(batch, "text", 16)), []) == batch.column(0).to_pylist()
