"""Token ids of a corpus as Simple-8b files.

Documents are range-partitioned and sorted by id; each partition encodes its
texts and writes files of about ``FILE_IDS`` ids.  A file, all little-endian:

    "S8B1", u32 documents, u64 ids, u32 blocks, u32 words, u32 escapes
    i64 document ids, u32 ids of each document
    u32 word offsets of the blocks, one more than blocks
    u64 words, u64 escaped values
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .arrow import mapped
from .files import put
from .store import Scratch, looked_up
from .tokens import encoder, vocabulary_path, with_end
from .words import slices

END, FILE_IDS = 2, 4_000_000
_HEAD = struct.Struct("<4sIQIII")


def packed(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escaped = simple8b.encode(ids.astype(np.uint64))
    head = _HEAD.pack(b"S8B1", len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escaped))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids of each document, all ids."""
    magic, n_docs, n_ids, blocks, words, escapes = _HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a token file")
    at, out = _HEAD.size, []
    for kind, n in (("<i8", n_docs), ("<u4", n_docs), ("<u4", blocks + 1), ("<u8", words), ("<u8", escapes)):
        out.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
        at += out[-1].nbytes
    doc_ids, sizes, offsets, coded, escaped = out
    return doc_ids, sizes, simple8b.decode(coded, offsets.astype(np.int64), escaped, n_ids).astype(np.uint32)


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(file, n_docs, n_ids) of the files that this call writes; names ascend with the document ids.

    Lazy: the files are there when the result has been computed.  A null text
    has the end id alone; rows with a null id are left out; rows that share an
    id, repeated ones too, stand side by side, by text.  An empty table writes no
    file.  Other columns are not read.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done = 0

        def flush() -> pa.RecordBatch:
            nonlocal done
            doc_ids, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"part-{task:06d}-{done:06d}.s8b"
            put(folder, name, packed(doc_ids, sizes, ids))
            held.clear()
            done += 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64())], names=["file", "n_docs", "n_ids"])

        for whole in batches:
            for part in slices(whole, "text"):
                ids, rows = with_end(*encoder(path).encode(part.column("text")), end)
                held.append((part.column("doc_id").to_numpy(), np.diff(rows), ids))
                if sum(len(h[2]) for h in held) >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()
        encoder(path).rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return mapped(dealt, run, "file string, n_docs long, n_ids long")


def read(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files of ``folder`` alone.

    Files are decoded once; how many ids each holds, and so where the next one
    starts, is counted from what was decoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                doc_ids, sizes, ids = unpacked(data.as_buffer())
                at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                if at[-1] != len(ids):
                    raise ValueError(f"damaged token file {name}")
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(doc_ids)), pa.array(doc_ids), pa.array(at[:-1]), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["file", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = scratch.table(mapped(files, run, "file string, doc_id long, local long, n_tokens long, ids_crc32 long"), "decoded")
    # one row a file: a few for each million documents
    held = found.groupBy("file").agg(F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.table(held.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")), "bases")
    return looked_up(found, base, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to the shared folder and return what the files hold."""
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = scratch.path("files")
    summaries = scratch.table(write(docs, folder, vocabulary, id_col, text_col), "summaries")
    if summaries.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(docs.sparkSession, folder, scratch)
