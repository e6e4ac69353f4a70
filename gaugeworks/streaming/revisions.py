"""Amounts that are stated again later: the newest statement counts, and totals take the old one back.

The ledger holds one row a key, in buckets of a versioned table; totals by group
lie beside it.  A batch rewrites the buckets that it touches, subtracts what its
keys counted before, adds what they count now, and publishes both together with
the batch's number, so a batch that is played again after a failure changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.sources import scratch
from gaugeworks.sources.versions import Versions

BUCKETS = 32
_ROLLUP = "rollup"


def revise(table: Versions, batch: DataFrame, number: int, buckets: int = BUCKETS) -> bool:
    """Take in ``batch`` (key, grp, amount, stated, day); false if that number was taken in before.

    Of statements of one key that with the largest ``stated`` counts (of equals
    the larger group and amount), whenever it arrives; ``day`` is the newest of
    any.  Rows without a key or ``stated`` are left out; a null amount counts as 0.
    """
    base = table.version()
    if base and base.note["batch"] >= number:
        return False
    if base and base.note["buckets"] != buckets:
        raise ValueError(f"the ledger has {base.note['buckets']} buckets")
    amount = F.coalesce(F.col("amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    named = batch.where("key is not null and stated is not null").select("key", F.struct("stated", "grp", amount.alias("amount")).alias("s"), "day")
    fresh = named.groupBy("key").agg(F.max("s").alias("s"), F.max("day").alias("day")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    fresh = scratch.written(fresh, "batch")
    touched = [f"bucket={r[0]}" for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` at most
    old = table.read(base, touched) if base else None
    if old is None:
        old = fresh.limit(0).select("key", "s", "day")
    before = old.select("key", F.col("s").alias("was"), F.col("day").alias("was_day"))
    stated_now = F.col("s").isNotNull()
    merged = fresh.drop("bucket").join(before, "key", "full").select(
        "key", F.greatest("s", "was").alias("s"), F.greatest("day", "was_day").alias("day"), "was", stated_now.alias("now"), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    )
    folder = table.stage(merged, "bucket")
    changed = table.spark.read.schema(merged.schema).parquet(f"{table.path}/{folder}").where("now")
    added = changed.select("s.grp", F.lit(1).cast("long").alias("n"), F.col("s.amount").cast("decimal(38,2)").alias("total"), "day")
    taken_back = changed.where("was is not null").select("was.grp", F.lit(-1).cast("long").alias("n"), (-F.col("was.amount")).cast("decimal(38,2)").alias("total"), F.lit(None).cast(fresh.schema["day"].dataType).alias("day"))
    totals = added.unionByName(taken_back)
    kept = table.read(base, [_ROLLUP]) if base else None
    if kept is not None:
        totals = totals.unionByName(kept)
    rollup = totals.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,2)").alias("total"), F.max("day").alias("day"))
    parts = dict(base.parts if base else {}) | {name: f"{folder}/{name}" for name in touched} | {_ROLLUP: table.stage(rollup.coalesce(1))}
    table.publish(parts, base, {"batch": number, "buckets": buckets})
    table.clean()
    return True


def ledger(table: Versions) -> DataFrame:
    """(key, grp, amount, stated, day) of the newest version; there must have been a key."""
    at = table.version()
    rows = table.read(at, [p for p in at.parts if p != _ROLLUP])
    return rows.select("key", "s.grp", "s.amount", "s.stated", "day")


def rollup(table: Versions) -> DataFrame:
    """(grp, n, total, day): keys and amounts that count for each group, and the newest day of any that did; groups that lost all keys are left out."""
    return table.read(None, [_ROLLUP]).where("n > 0")


def keep_revised(statements: DataFrame, table: Versions, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Take in what a stream of statements holds, batch by batch, and stop."""

    def put(batch: DataFrame, number: int) -> None:
        revise(table, batch, number, buckets)

    statements.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
