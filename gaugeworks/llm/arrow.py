"""Functions over Arrow batches in tasks, with small batches and memory given back.

Python workers live on between tasks and share their executor's memory with the
JVM, so batches are bounded by bytes and freed memory goes back to the system
when a task ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows in one batch at most (about); one row at least.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, unless they are smaller already."""
    with suppress(PySparkException):
        now = spark.conf.get(_LIMIT).removesuffix("b")  # other units: set by the user
        if now.isdigit() and int(now) > BATCH_BYTES:
            spark.conf.set(_LIMIT, str(BATCH_BYTES))


def mapped(rows: DataFrame, run: Run, schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with small batches; each task trims its worker at its end."""
    small_batches(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return rows.mapInArrow(task, schema)
