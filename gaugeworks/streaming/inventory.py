"""Requests collected over recurring daily lists: one row a request, kept as state across runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gaugeworks.sources import scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Sightings that a task holds before it puts those of a request together.
HELD = 262_144


def _put_together(rows: pa.Table, keys: Sequence[str], fields: int) -> pa.Table:
    """One row for each key: the first, the last, the flags of any, each field's earliest statement."""
    rows = rows.combine_chunks()
    code = np.zeros(len(rows), np.int64)
    for k in keys:
        kinds = pc.dictionary_encode(rows[k].combine_chunks(), null_encoding="encode")
        kinds = kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds
        code = np.unique(code * len(kinds.dictionary) + kinds.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    start = np.flatnonzero(np.diff(code[order], prepend=-1))
    found = dict(zip(keys, rows.select(keys).take(pa.array(order[start])).columns, strict=True))
    ends = np.iinfo(np.int64)
    for name, best, none in (("first", np.minimum, ends.max), ("last", np.maximum, ends.min), ("flags", np.bitwise_or, 0)):
        x = best.reduceat(pc.fill_null(rows[name], none).to_numpy()[order], start)
        found[name] = pa.array(x, mask=(x == none) & (name != "flags"))
    for i in range(fields):
        names = [f"at{i}", f"id{i}", f"value{i}"]
        stated = pa.table({"code": code, "row": np.arange(len(rows)), **{c: rows[c] for c in names}}).filter(pc.is_valid(rows[names[0]]))
        stated = stated.sort_by([(c, "ascending") for c in ("code", *names)])
        of, at = np.unique(stated["code"].to_numpy(), return_index=True)
        best = np.full(len(start), -1)
        best[of] = stated["row"].to_numpy()[at]
        found |= {c: rows[c].take(pa.array(best, mask=best < 0)) for c in names}
    return pa.table([found[c] for c in rows.schema.names], schema=rows.schema)


def together(sightings: DataFrame, keys: Sequence[str], fields: int) -> DataFrame:
    """Sightings of a batch, dealt by key, as one row a request; more where a task holds more than ``HELD`` requests."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD:
                whole = _put_together(pa.Table.from_batches(held), keys, fields)
                held, n = whole.to_batches(), len(whole)
                if n > HELD // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from _put_together(pa.Table.from_batches(held), keys, fields).to_batches()

    return sightings.repartition(*keys).mapInArrow(run, sightings.schema)


class Requests(StatefulProcessor):
    """A request's first and last sighting, the flags of any sighting, and the first value of each field.

    Sightings may come in any order: a field keeps the value of its earliest
    sighting that has one, by time and then id.  A request that has not been
    seen for ``stale_days`` when the watermark passes is closed by a timer, and
    open again when it is seen later.  All that is known of a request is one
    value of state with its timer: each look at state is a message to the JVM.
    """

    def __init__(self, keys: Sequence[str], fields: Sequence[str], stale_days: int):
        self.keys, self.fields, self.stale_ms = list(keys), list(fields), stale_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        stated = "".join(f", at{i} long, id{i} long, value{i} string" for i in range(len(self.fields)))
        self.known = handle.getValueState("known", f"first long, last long, flags long, changes long, timer long{stated}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last, flags, changes, timer, *stated = self.known.get() or (None, None, 0, 0, None, *(None, None, None) * len(self.fields))
        before = last
        best = [tuple(stated[k : k + 3]) for k in range(0, len(stated), 3)]
        for r in rows:
            since, until, seen, *states = r[len(self.keys) : -1]
            if until is not None:
                first = since if first is None else min(first, since)
                last = until if last is None else max(last, until)
            flags |= seen
            for i in range(len(best)):
                new = tuple(states[3 * i : 3 * i + 3])
                if new[0] is not None and (best[i][0] is None or new < best[i]):
                    best[i] = new
        if last != before:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = last // 1000 + self.stale_ms
            self.handle.registerTimer(timer)
        return self._kept(key, first, last, flags, changes + 1, timer, best, "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, flags, changes, _, *stated = self.known.get()
        return self._kept(key, first, last, flags, changes + 1, None, [tuple(stated[k : k + 3]) for k in range(0, len(stated), 3)], "closed")

    def close(self) -> None:
        pass

    def _kept(self, key, first, last, flags, changes, timer, best, status) -> Iterator[Row]:
        self.known.update((first, last, flags, changes, timer, *(x for b in best for x in b)))
        named = dict(zip(self.keys, key, strict=True)) | {"first": first, "last": last, "flags": flags}
        yield Row(**named, **{f: b[2] for f, b in zip(self.fields, best, strict=True)}, **{f"{f}_at": b[0] for f, b in zip(self.fields, best, strict=True)}, changes=changes, status=status)


def requests(sightings: DataFrame, keys: Sequence[str], at: str, order: str, flags: str, fields: Sequence[str], late: str = "7 days", stale_days: int = 21) -> DataFrame:
    """The stream of changes: keys, first, last, flags, each field and the time it was stated, changes, status.

    ``flags`` is a bit mask, ``fields`` are strings (null or empty: not stated),
    times are microseconds, ``changes`` numbers a request's rows.  A request's
    sightings in a batch are put together before they meet its state; they are
    not taken in where the newest of them is more than ``late`` behind the newest
    one of all.
    """
    seen, order = F.unix_micros(F.col(at).cast("timestamp")), F.col(order).cast("long")
    stated = [(F.col(f).cast("string"), F.length(F.col(f).cast("string")) > 0) for f in fields]
    parts = [F.when(known, x).alias(f"{c}{i}") for i, (text, known) in enumerate(stated) for c, x in (("at", seen), ("id", order), ("value", text))]
    given = sightings.select(*keys, seen.alias("first"), seen.alias("last"), F.coalesce(F.col(flags).cast("long"), F.lit(0)).alias("flags"), *parts)
    given = together(given, keys, len(fields)).withColumn("_seen", F.timestamp_micros("last")).withWatermark("_seen", late)
    kinds = [f"{k} {sightings.schema[k].dataType.simpleString()}" for k in keys]
    out = StructType.fromDDL(", ".join([*kinds, "first long, last long, flags long", *(f"{f} string" for f in fields), *(f"{f}_at long" for f in fields), "changes long, status string"]))
    return given.groupBy(*keys).transformWithState(Requests(keys, fields, stale_days), out, "Update", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """State kept in RocksDB, which this kind of state needs, for streams started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def collect_available(changes: DataFrame, checkpoint: str, folder: str) -> None:
    """Take in what is there and stop; a batch that is repeated after a failure writes its folder anew."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:012d}")

    with rocks(changes.sparkSession):
        changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each request."""
    rows = spark.read.parquet(folder).drop("batch")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "changes").alias("_r")).select(*keys, "_r.*")


def inventory(sightings: DataFrame, keys: Sequence[str], at: str, order: str, flags: str, fields: Sequence[str], late: str = "7 days", stale_days: int = 21) -> DataFrame:
    """One run over all that a stream of sightings holds, as a table."""
    spark = sightings.sparkSession
    home = scratch.folder(spark, "inventory")
    collect_available(requests(sightings, keys, at, order, flags, fields, late, stale_days), f"{home}/checkpoint", f"{home}/rows")
    return current(spark, f"{home}/rows", keys)
