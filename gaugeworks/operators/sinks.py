"""Writes with conditions: gated, insert-only, stamped, checked for equality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A gate found rows that break its rules; nothing was written. ``broken`` counts them by rule."""

    def __init__(self, broken: dict[str, int]):
        super().__init__(f"not written: {broken}")
        self.broken = broken


def gated_write(rows: DataFrame, path: str, checks: dict[str, Callable[[DataFrame], int]], mode: str = "errorifexists") -> None:
    """Write Parquet when every check counts 0 violations, else raise ``Refused`` and write nothing."""
    broken = {k: n for k, f in checks.items() if (n := f(rows))}
    if broken:
        raise Refused(broken)
    rows.write.mode(mode).parquet(path)


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` untouched, and the rows of ``new`` whose key is not in it."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def stamped(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``old`` with ``fields`` replaced where ``new`` has a value for the key; ``new`` has one row a key."""
    fresh = new.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    return old.join(fresh, list(keys), "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with their side; empty when both hold the same rows as often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def planned(rows: DataFrame, change: Column, to: Column, column: str) -> tuple[DataFrame, DataFrame]:
    """A dry run and its result: the rows that would change with old and new value, and all rows after the change."""
    plan = rows.where(change).withColumn("_new", to).withColumnRenamed(column, "old").withColumnRenamed("_new", "new")
    return plan, rows.withColumn(column, F.when(change, to).otherwise(F.col(column)))
