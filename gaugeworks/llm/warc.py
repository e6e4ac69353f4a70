"""WARC archives with a Zstandard dictionary of their own, written and read by Spark tasks.

Pages with equal payloads share one response record, that of the largest page
id; the others are revisit records that refer to it.  Each file begins with a
skippable frame that holds a dictionary built from the file's own records; every
record after it is a frame of its own, compressed with that dictionary, so a
record can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import mapped
from .files import put
from .store import Scratch

#: Payload bytes of a file (about), of the dictionary, and of the records it is built from.
FILE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 20, 64 << 10, 4 << 20
#: Bytes of a record that the dictionary takes or leaves as one, and of the first step into a frame.
PIECE_BYTES, STEP = 16 << 10, 1 << 10
LEVEL = 3
#: The magic number of a dictionary's skippable frame and of a Zstandard frame.
_SKIPPABLE, _DATE = 0x184D2A5D, "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record: the payload for a response, none for a revisit."""
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary from pieces drawn evenly over all records, of long ones from every part; raw content where there are too few to train on."""
    import zstandard

    pieces = [r[k : k + PIECE_BYTES] for r in records for k in range(0, len(r), PIECE_BYTES)]
    drawn = pieces[:: max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, drawn)) // 16))
    try:
        return zstandard.train_dictionary(size, drawn, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(drawn)[:size].ljust(8, b" ")


def archive(records: list[bytes]) -> bytes:
    import zstandard

    raw = _dictionary(records)
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind), write_content_size=True)
    return b"".join([struct.pack("<II", _SKIPPABLE, len(raw)), raw, *map(press.compress, records)])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != _SKIPPABLE:
        raise ValueError("no dictionary at the start of the archive")
    raw = bytes(memoryview(data)[8 : 8 + size])
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    view, at = memoryview(data), 8 + size
    while at < len(view):
        # one frame in growing steps: its end is not known before
        reader, parts, step = press.decompressobj(), [], STEP
        while not reader.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            given = view[at : at + step]
            parts.append(reader.decompress(given))
            at, step = at + len(given), 2 * step
        at -= len(reader.unused_data)
        whole = b"".join(parts)
        head, _, block = whole.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest): the UTF-8 payload and its SHA-1 in base32."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return given.where("page_id is not null").withColumn("digest", F.unhex(F.sha1("payload")))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(file, n_records) of the archives that this call writes, lazily.

    There is a record for every row.  Payloads of at least ``least_bytes`` are
    stored once: of rows that share an id and a payload one is the response, if
    the id is the payload's largest, and the others revisit it.  Null html is an
    empty payload; a null url an empty one.  Rows with a null id are left out.
    Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "digests")
    rows = digests(pages, id_col, url_col, html_col)
    keys = scratch.table(rows.select("page_id", "digest", F.length("payload").alias("size")).distinct(), "keys")
    owners = scratch.table(keys.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "owners")
    # only pages with a shared payload need to know its owner
    revisits = scratch.table(keys.join(owners, "digest").where("page_id <> owner").select("page_id", "digest", "owner"), "revisits")
    referred = rows.join(revisits, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, size = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        seen: tuple[int, str] | None = None  # rows of one id and payload follow each other

        def flush() -> pa.RecordBatch:
            nonlocal done, size
            name = f"part-{task:06d}-{done:06d}.warc.zst"
            put(folder, name, archive(held))
            n = len(held)
            held.clear()
            done, size = done + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])

        for batch in batches:
            columns = [batch.column(k) for k in ("page_id", "url", "payload", "digest", "owner")]
            for page_id, url, payload, digest, owner in zip(*columns, strict=True):
                key = (page_id.as_py(), base64.b32encode(digest.as_py()).decode())
                body, refers_to = payload.as_py(), owner.as_py()
                if key == seen and refers_to is None and len(body) >= least_bytes:
                    refers_to = key[0]
                seen = key
                held.append(record(key[0], url.as_py(), body, key[1], refers_to))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    dealt = referred.repartition("page_id").sortWithinPartitions("page_id", "digest").select("page_id", "url", "payload", "digest", "owner")
    return mapped(dealt, run, "file string, n_records long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records; responses are digested anew."""

    def number(urn: str | None) -> int | None:
        return int(urn.rsplit(":", 1)[1].rstrip(">")) if urn else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for head, block in records(data.as_buffer()):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and digest != base64.b32encode(hashlib.sha1(block).digest()).decode():
                        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                    rows.append((number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), digest, head["WARC-Type"], number(head.get("WARC-Refers-To"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return mapped(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive ``pages`` in the shared folder and return what the archives hold."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("files")
    summaries = scratch.table(write(pages, folder, least_bytes, id_col, url_col, html_col), "summaries")
    if summaries.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(pages.sparkSession, folder)
