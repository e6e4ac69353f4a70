"""Lineage cuts, and running totals over ranges of values instead of one window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import written


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` computed, written to the folder that all executors share, and read back; removed when the process ends."""
    return written(rows, "range")


def running(by_value: DataFrame, group: Sequence[str], value: str, counts: Sequence[str], descending: bool = False) -> DataFrame:
    """``by_value`` with ``<count>_upto``: the sum of each count over the group's values up to and with this one.

    Values are dealt by range, so a group of any size is spread over tasks; a
    window runs within each range, and what came before it is added from the
    ranges' totals, a row for each group and range.
    """
    order = F.desc(value) if descending else F.asc(value)
    dealt = checkpointed(by_value.repartitionByRange(*map(F.asc, group), order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # ranges are numbered in the order of the values
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*group, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in counts))
    totals = totals.select(*group, "_range", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in counts))
    joined = dealt.join(totals, [*group, "_range"])
    return joined.select(*by_value.columns, *((F.sum(c).over(within) + F.col(f"_{c}")).alias(f"{c}_upto") for c in counts))
