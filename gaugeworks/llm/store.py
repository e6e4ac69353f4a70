"""Scratch tables in the folder that all executors share.

Long jobs cut their lineage by writing an intermediate table and reading it
back.  The folder comes from ``spark.checkpoint.dir``; only where that is unset
and Spark runs in one machine does this module pick a folder of its own.
Operators drop tables that nothing reads any more; the rest, which a lazy result
may still read, goes when the driver's process ends (or earlier, by
``Scratch.close``).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI.

    Order: the session's ``spark.checkpoint.dir``, a checkpoint folder set on
    the context, and, in local mode only, a temporary folder of this process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gaugeworks-"))
        import shutil

        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Scratch:
    """Tables of one job, under one folder; ``drop`` removes those no longer needed, ``close`` all of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads the files."""
        to = self.path(name)
        df.write.parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._scratch_path = to
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._scratch_path)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def close(self) -> None:
        """Remove the whole folder; results that read its tables can't be computed afterwards."""
        with suppress(Exception):  # the session may have ended before
            if self._n:
                self.remove(self.root)


#: Ids that are sent to all executors at most, about 40 MB of hash table.
BROADCAST_IDS = 1_000_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a written table of a few columns, one row a key; broadcast under the same bound.

    A null key matches nothing: such rows go with an inner join and stay, their
    facts null, with a left one.
    """
    if facts.count() <= BROADCAST_IDS:
        facts = F.broadcast(facts)
    return rows.join(facts, key, how)


def by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` semi- or anti-joined with a written one-column table of distinct ids.

    The ids are broadcast while there are at most ``BROADCAST_IDS``, counted
    from the written table, so that wide rows stay where they are; beyond that
    both sides are shuffled by id.  Rows with a null id match nothing: a semi
    join leaves them out, an anti join keeps them.
    """
    (key,) = ids.columns
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, key, how)


def one_text(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (doc_id, text) with one row an id; of rows that share an id the least text stays, a null last.

    Ids are counted without their texts.  Where none repeats, ``rows`` come back
    as they are; else only the rows of repeated ids are grouped.
    """
    twice = scratch.table(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return rows
    again = by_ids(rows, twice, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return by_ids(rows, twice, "left_anti").unionByName(scratch.table(again, "once"))
