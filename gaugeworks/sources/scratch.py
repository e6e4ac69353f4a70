"""Folders for intermediate tables and stream checkpoints that all executors share.

They lie under ``spark.checkpoint.dir``; only where that is unset and Spark runs
in one machine is a temporary folder made.  What a session made goes when the
driver's process ends: a result may read its tables until then.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def root(spark: SparkSession) -> str:
    """The session's shared folder, the context's checkpoint folder or, in one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="gaugeworks-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def removed(spark: SparkSession, path: str) -> None:
    system, p = filesystem(spark, path)
    system.delete(p, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path; the folder is removed at the end of the process."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        with suppress(Exception):  # the session may have ended before
            removed(spark, path)

    atexit.register(remove)
    return path


def written(rows: DataFrame, name: str = "table") -> DataFrame:
    """``rows`` computed, written as Parquet and read back: cuts the lineage."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
