"""Repeated passages by a sparse suffix array over words.

Plan
----
1. Suffixes are kept at content-selected places only: of every ``LENGTH -
   GRAM + 1`` consecutive word grams the one of least hash (leftmost of equals)
   is a minimiser, and the suffix that begins there is retained.  Both copies of
   a repeated passage of ``LENGTH`` words retain the same suffix inside it.
2. The retained suffixes are sorted by their leading gram, which stands as one
   symbol in front of the words that follow it.  Suffixes whose gram no
   neighbour shares can't match and go; the others are given their context, the
   ``LENGTH - GRAM`` words after the gram and those before it.
3. They are sorted by gram and the words that follow, word by word, and each is
   compared with its two neighbours: the longer common prefix is as far as it
   matches any suffix to the right.  Sorted by gram and the words before, read
   backwards, the same comparison tells how far it matches to the left.
   Suffixes that reach fewer than ``LENGTH`` words in both directions go.
4. The windows of ``LENGTH`` words within a suffix's reach are looked up: one
   neighbour may match further right and another further left, and a passage's
   first place may be in neither.  Windows that occur twice make up the maximal
   spans, so the result is exact: a word is in a span if and only if it lies in
   a passage of ``LENGTH`` words that occurs at two places.

All sorts are range partitions over (gram, words, document, place), so that even
a gram found everywhere is spread over tasks.  The first and the last row of a
partition have a neighbour elsewhere; they count as agreeing with it as far as
possible, two rows a partition, and step 4 decides.

Documents with the same word sequence are one class before that, and only the
one of least id takes part; the others are copies of it as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import mapped
from .store import Scratch, by_ids, one_text
from .words import Words, slices, utf8

LENGTH, GRAM = 50, 20
_PLACE = np.uint64((1 << 24) - 1)
_REACH = "doc_id long, place int, reach int"


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys, by doubling."""
    span, out = 1, keys
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _minimisers(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row-local place of the retained suffixes, in order, and row offsets into them."""
    grams, rows = words.grams(gram)
    width = length - gram + 1
    n = len(rows) - 1
    if len(grams) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    index = np.arange(len(grams), dtype=np.uint64)
    least = _window_min((grams & ~_PLACE) | (index & _PLACE), width)
    starts = np.arange(len(least), dtype=np.int64)
    owner = np.searchsorted(rows, starts, side="right") - 1
    starts = starts[starts + width <= rows[owner + 1]]
    place = starts + ((least[starts] - starts.astype(np.uint64)) & _PLACE).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    owner = np.searchsorted(rows, place, side="right") - 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return grams[place], place - rows[owner], ends


def suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, k1, k2, grams, places): a key of the word sequence and the retained suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"))
                hashes, places, at = _minimisers(words, length, gram)
                key = np.zeros((part.num_rows, 2), dtype=np.int64)
                for i in range(part.num_rows):
                    own = words.hashes[words.rows[i] : words.rows[i + 1]]
                    key[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), dtype=np.int64)
                at = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(words.rows).astype(np.int64)),
                        pa.array(key[:, 0]),
                        pa.array(key[:, 1]),
                        pa.ListArray.from_arrays(at, pa.array(hashes.view(np.int64))),
                        pa.ListArray.from_arrays(at, pa.array(places.astype(np.int32))),
                    ],
                    names=["doc_id", "n_words", "k1", "k2", "grams", "places"],
                )

    return mapped(docs, run, "doc_id long, n_words long, k1 long, k2 long, grams array<long>, places array<int>")


def _sorted_runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Columns of the batches, each batch led by the last two rows before it; whether it begins and ends the partition."""
    held, ahead = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in columns]
        if ahead is not None and len(ahead[0]) > 1:
            yield ahead, held is None, False
            held = [x[-2:] for x in ahead]
        ahead = now if ahead is None else [np.concatenate([x[-2:], y]) for x, y in zip(ahead, now, strict=True)]
    if ahead is not None:
        yield ahead, held is None, True


def _judged(width: int, columns: tuple[str, ...], common) -> Callable:
    """Sorted rows as (doc_id, place, reach): the larger common prefix with either neighbour, ``width`` at a partition's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins, ends in _sorted_runs(batches, columns):
            n = len(rows[0])
            pair = common(rows)  # of each row with its successor
            reach = np.zeros(n, dtype=np.int64)
            reach[1:] = pair
            reach[:-1] = np.maximum(reach[:-1], pair)
            if begins:
                reach[0] = width
            if ends:
                reach[-1] = width
            # led rows: the first is only a neighbour, the last waits for its successor
            take = slice(0 if begins else min(1, n - 1), n if ends else n - 1)
            doc, place = (rows[columns.index(k)][take] for k in ("doc_id", "place"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(reach[take].astype(np.int32))], names=["doc_id", "place", "reach"])

    return run


def _same_gram(rows: list[np.ndarray]) -> np.ndarray:
    return (rows[0][1:] == rows[0][:-1]).astype(np.int64)


def _common_words(rows: list[np.ndarray]) -> np.ndarray:
    """Words that each row's context shares with its successor's from its start; none across grams."""
    width = len(rows[1][0]) // 2
    words = np.frombuffer(b"".join(rows[1]), dtype=">u2").reshape(-1, width)
    alike = (words[1:] == words[:-1]) & (words[1:] != 0)
    return np.where(rows[0][1:] == rows[0][:-1], np.where(alike.all(axis=1), width, (~alike).argmax(axis=1)), 0)


def _contexts(length: int, gram: int):
    """The retained suffixes of (doc_id, text, places) with the words after and, backwards, before their gram.

    A word is two bytes of its hash, 0 beyond the text: contexts of equal words
    are equal, and a chance agreement of others only makes more to look up.
    """
    width = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"))
                hashes, rows = words.grams(gram)
                places = part.column("places")
                found = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
                short = np.maximum(words.hashes & np.uint64(0xFFFF), 1).astype(">u2")
                short = np.concatenate([short, np.zeros(1, ">u2")])
                first, last = words.rows[:-1][of], words.rows[1:][of]
                after = (first + found + gram)[:, None] + np.arange(width)
                before = (first + found - 1)[:, None] - np.arange(width)
                after = short[np.where(after < last[:, None], after, -1)]
                before = short[np.where(before >= first[:, None], before, -1)]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                kind = pa.binary(2 * width)
                sides = [pa.FixedSizeBinaryArray.from_buffers(kind, len(found), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary()) for x in (after, before)]
                arrays = [pa.array(hashes[rows[of] + found].view(np.int64)), pa.array(ids[of]), pa.array(found.astype(np.int32)), *sides]
                yield pa.RecordBatch.from_arrays(arrays, names=["gram", "doc_id", "place", "after", "before"])

    return run


def _windows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words = Words(part.column("text"))
                hashes, rows = words.grams(length)
                n = np.diff(rows)
                places = part.column("places")
                found, left, right = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in places.flatten().flatten())
                of = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
                # windows that lie within the reach of a suffix
                mark = np.zeros(len(hashes) + 1, dtype=np.int64)
                lo, hi = np.maximum(found - left, 0), np.minimum(found + gram + right - length + 1, n[of])
                some = lo < hi
                np.add.at(mark, rows[of[some]] + lo[some], 1)
                np.add.at(mark, rows[of[some]] + hi[some], -1)
                take = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                owner = np.searchsorted(rows, take, side="right") - 1
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[take].view(np.int64)), pa.array(ids[owner]), pa.array((take - rows[owner]).astype(np.int32))],
                    names=["window", "doc_id", "place"],
                )

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, removed, first_doc_id): spans of words that occur twice.

    A passage of ``length`` words (A-Z lowered, split at white space) that
    occurs at two places is repeated.  Its first place, by id and then by
    position, stays: spans with ``removed`` false.  Its later places are spans
    with ``removed`` true; ``first_doc_id`` is the least document that such a
    span repeats.  Passages that overlap their own first place lose only the
    part beyond it.  Texts that are null, empty or shorter than ``length`` words
    have no spans; rows with a null id are left out; rows that share an id,
    repeated ones too, are one text, the least of them.  An empty table gives an
    empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = one_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null"), scratch)
    kept = scratch.table(suffixes(texts, length, gram), "suffixes")
    long = kept.where(F.col("n_words") >= length)
    classes = scratch.table(long.groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    spread = (
        long.join(classes.select("k1", "k2", "n_words", F.col("rep").alias("doc_id")), ["k1", "k2", "n_words", "doc_id"], "left_semi")
        .select("doc_id", F.explode(F.arrays_zip("grams", "places")).alias("s"))
        .select(F.col("s.grams").alias("gram"), "doc_id", F.col("s.places").alias("place"))
    )
    array = scratch.table(spread, "spread")

    def reaches(rows: DataFrame, order: tuple[str, ...], width: int, common) -> DataFrame:
        return mapped(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), _judged(width, order, common), _REACH)

    def of_documents(found: DataFrame, value: Column) -> DataFrame:
        places = scratch.table(found.groupBy("doc_id").agg(F.collect_list(value).alias("places")), "places")
        return by_ids(texts, places.select("doc_id"), "left_semi").join(places, "doc_id")

    agreeing = scratch.table(reaches(array, ("gram", "doc_id", "place"), 1, _same_gram).where("reach > 0"), "agreeing")
    scratch.drop(array)
    context = mapped(of_documents(agreeing, F.col("place")), _contexts(length, gram), "gram long, doc_id long, place int, after binary, before binary")
    context = scratch.table(context, "context")
    scratch.drop(agreeing)
    right, left = (reaches(context, ("gram", side, "doc_id", "place"), length - gram, _common_words) for side in ("after", "before"))
    none = F.lit(None).cast("int")
    both = right.select("doc_id", "place", F.col("reach").alias("right"), none.alias("left")).unionByName(left.select("doc_id", "place", none.alias("right"), F.col("reach").alias("left")))
    both = both.groupBy("doc_id", "place").agg(F.max("left").alias("left"), F.max("right").alias("right")).where(F.col("left") + gram + F.col("right") >= length)
    both = scratch.table(both, "reaches")
    scratch.drop(context)
    some = of_documents(both, F.struct("place", "left", "right"))
    windows = scratch.table(mapped(some, _windows(length, gram), "window long, doc_id long, place int"), "windows")
    twice = scratch.table(
        windows.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("f")).where("n > 1").select("window", F.col("f.doc_id").alias("first_doc"), F.col("f.place").alias("first_place")),
        "twice",
    )
    same = F.col("first_doc") == F.col("doc_id")
    removed = ~(same & (F.col("first_place") == F.col("place")))
    low = F.when(same & removed, F.greatest("place", F.col("first_place") + length)).otherwise(F.col("place"))
    cover = windows.join(twice, "window").select("doc_id", "first_doc", removed.alias("removed"), low.alias("lo"), (F.col("place") + length).alias("hi")).where("lo < hi")
    order = Window.partitionBy("doc_id", "removed").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        cover.withColumn("new", F.when(F.col("lo") > reach, 1).otherwise(0))
        .withColumn("island", F.sum("new").over(order))
        .groupBy("doc_id", "removed", "island")
        .agg(F.min("lo").cast("long").alias("start_word"), F.max("hi").cast("long").alias("end_word"), F.min("first_doc").alias("first_doc_id"))
        .select("doc_id", "start_word", "end_word", "removed", "first_doc_id")
    )
    whole = (
        kept.select("doc_id", "n_words", "k1", "k2")
        .join(classes.where("n > 1"), ["k1", "k2", "n_words"])
        .select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), (F.col("doc_id") != F.col("rep")).alias("removed"), F.col("rep").alias("first_doc_id"))
        .distinct()
    )
    return spans.unionByName(whole)


def _cut(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, column):
                words = Words(part.column(column))
                raw = utf8(part.column(column))[0].tobytes()
                text, kept = part.column(column).to_pylist(), []
                for i, cuts in enumerate(part.column("__cuts").to_pylist()):
                    lo, hi = words.base[i], words.base[i + 1]
                    own = words.starts[words.rows[i] : words.rows[i + 1]]
                    left = len(own)
                    if cuts:
                        parts, at, done = [], lo, 0
                        for c in sorted(cuts, key=lambda c: (c["s"], c["e"])):
                            s, e = max(c["s"], done), c["e"]
                            if s >= e:
                                continue
                            parts.append(raw[at : own[s]])
                            at = own[e] if e < len(own) else hi
                            left -= e - s
                            done = e
                        parts.append(raw[at:hi])
                        text[i] = b"".join(parts).decode()
                    kept.append(left > 0 or not cuts)
                arrays = [pa.array(text, pa.string()) if n == column else part.column(n) for n in part.schema.names if n != "__cuts"]
                out = pa.RecordBatch.from_arrays(arrays, names=[n for n in part.schema.names if n != "__cuts"])
                yield out.filter(pa.array(kept))

    return run


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut from their texts; all columns stay.

    A document of which no word is left is dropped.  Documents without a removed
    span, null and empty texts among them, come back unchanged.
    """
    scratch = Scratch(docs.sparkSession, "cut")
    cuts = scratch.table(
        spans.where("removed").groupBy(F.col("doc_id").alias(id_col)).agg(F.collect_set(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("__cuts")), "cuts"
    )
    ids = cuts.select(id_col)
    rest = by_ids(docs, ids, "left_anti")
    changed = by_ids(docs, ids, "left_semi").join(cuts, id_col).select(*docs.columns, "__cuts")
    return rest.unionByName(mapped(changed, _cut(text_col), docs.schema))
