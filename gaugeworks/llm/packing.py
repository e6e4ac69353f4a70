"""Best-fit packing of tokenized documents into fixed sequences, by hierarchical residual packing.

Plan
----
1. Each document becomes its ids and an end id; only documents longer than a
   sequence are cut, into full pieces and a rest.  A piece is a small row with a
   number of its own.
2. Every partition packs its pieces best-fit, longest first.  Sequences that are
   full up to ``SLACK`` are emitted.
3. The underfull ones are items of the next round: they are dealt anew to a
   quarter of the partitions and packed best-fit again.  A round carries item
   numbers and lengths only, and writes where each item went; the pieces follow
   at the end, round by round.
4. An item that fits with none of the others (its length and the least of all
   exceed a sequence) is emitted too.  Rounds end when nothing is left or when
   one partition holds all that is left, so no two items that fit together stay
   apart for want of a round.  A partition never gets more than about ``ITEMS``
   items, so no task holds the corpus.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .store import Scratch, looked_up
from .tokens import encoder, vocabulary_path, with_end
from .words import slices

LENGTH, END = 4096, 1
#: Free places of a sequence that counts as full; items of a partition; partitions joined each round.
SLACK, ITEMS, FAN_IN = 4, 200_000, 4
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, number) of every document; null texts have the end id alone.

    ``number`` tells pieces apart, those of repeated rows as well; it changes
    when the result is computed again, so write it before use.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_ = np.int64(TaskContext.get().partitionId()) << 38
        for whole in batches:
            for part in slices(whole, "text"):
                ids, rows = with_end(*encoder(path).encode(part.column("text")), end)
                size = np.diff(rows)
                count = -(-size // length)
                owner = np.repeat(np.arange(len(size)), count)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = number * length
                used = np.minimum(size[owner] - start, length)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (rows[owner] + start) * 4
                sums = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), used.tolist(), strict=True)]
                arrays = [part.column("doc_id").take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(used, pa.int64()), pa.array(sums, pa.int64()), pa.array(next_ + np.arange(len(owner)))]
                next_ += len(owner)
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "number"])
        encoder(path).rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"{_PIECES}, number long")


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Items by sequence: longest first (of equals in given order), each into the fullest sequence that has room (of equals the first)."""
    free: list[tuple[int, int]] = []  # (room, sequence), ascending
    out: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        k = bisect_left(free, (n, -1))
        if k == len(free):
            out.append([i])
            room, at = length - n, len(out) - 1
        else:
            room, at = free.pop(k)
            out[at].append(i)
            room -= n
        if room:
            insort(free, (room, at))
    return out


def _pack(length: int, turn: int):
    """One round over a partition's items (item, used): where each goes, and how full that sequence is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("item").to_numpy(), b.column("used").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        item, used = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(item)  # arrival differs between attempts
        item, used = item[order], used[order]
        bins = best_fit(used, length)
        order = np.array([i for b in bins for i in b])
        count = np.array([len(b) for b in bins])
        owner = np.repeat(np.arange(len(bins)), count)
        ends = np.cumsum(used[order])
        filled = np.add.reduceat(used[order], np.cumsum(count) - count)
        offset = ends - used[order] - (np.cumsum(filled) - filled)[owner]
        ids = (np.int64(turn) << 56) + (np.int64(TaskContext.get().partitionId()) << 32) + owner
        for lo in range(0, len(order), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            arrays = [item[order[cut]], ids[cut], offset[cut], filled[owner[cut]]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["item", "sequence", "offset", "filled"])

    return run


def packed(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, slack: int = SLACK, items: int = ITEMS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    ``offset`` is the piece's place in its sequence; places are gapless from 0.
    Null and empty texts are documents of the end id alone.  Rows with a null id
    are packed like others; rows that share an id, repeated ones too, are
    documents of their own.  Pieces of equal length are packed in the order of
    their numbers.  An empty table gives an empty result; other columns are not
    read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.table(pieces(docs, vocabulary, id_col, text_col, length, end), "pieces")
    open_ = cut.select(F.col("number").alias("item"), F.col("length").alias("used"))
    left, turn, rounds = cut.count(), 1, []
    parts = max(-(-left // items), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, min(parts, left // 2000))
    while left:
        # dealt by the items' own numbers: the same rows again after a lost executor
        dealt = open_.repartition(parts, F.xxhash64("item", F.lit(turn)))
        rounds.append(scratch.table(mapped(dealt, _pack(length, turn), "item long, sequence long, offset long, filled long"), "round"))
        if parts == 1:
            break
        under = rounds[-1].where((F.col("offset") == 0) & (F.col("filled") < length - slack)).select(F.col("sequence").alias("item"), F.col("filled").alias("used"))
        least = under.agg(F.min("used")).first()[0]
        if least is None:
            break
        open_ = under.where(F.col("used") + least <= length)
        left, turn = open_.count(), turn + 1
        if left < 2:
            break
        parts = max(-(-parts // FAN_IN), -(-left // items), 1)
    if not rounds:
        return spark.createDataFrame([], f"{_PIECES}, sequence_id long, offset long")
    # from the last round back: where each round's sequences end up
    place = None
    for round_ in reversed(rounds):
        if place is None:
            place = round_.select("item", "sequence", "offset")
        else:
            above = place.select(F.col("item").alias("sequence"), F.col("sequence").alias("_s"), F.col("offset").alias("_o"))
            joined = looked_up(round_, above, "sequence", "left")
            place = scratch.table(joined.select("item", F.coalesce("_s", "sequence").alias("sequence"), (F.col("offset") + F.coalesce("_o", F.lit(0))).alias("offset")), "place")
    found = place.select(F.col("item").alias("number"), F.col("sequence").alias("sequence_id"), "offset")
    return cut.join(found, "number").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
