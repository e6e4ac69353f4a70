"""Queries that keep state: streams run over the tables, versions, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.operators import sinks
from gaugeworks.sources import scratch
from gaugeworks.sources.readers import table
from gaugeworks.sources.versions import Versions, rewritten
from gaugeworks.streaming import inventory, revisions, windows

from .catalog import query

#: Statements in one landed file, about: a batch has as many files as it needs, so no task holds a quarter of the table.
FILE_ROWS = 500_000


def _sightings(rows: DataFrame) -> DataFrame:
    """Events as daily sightings of a user's requests: flags of programmes, a period and, rarely, a decision."""
    return rows.select(
        "user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("1 << cast(event_id % 7 % 3 as int)").cast("long").alias("flags"),
        F.when(F.col("value") < 20, F.concat(F.lit("period "), "event_id")).alias("period"), F.when(F.col("value") > 60, F.concat(F.lit("decision "), "event_id")).otherwise("").alias("decision"),
    )


@query("""
with e as (select user_id, event_type, event_id, ts, epoch_us(ts) as us, (1 << cast(event_id % 7 % 3 as int)) as flag, case when value < 20 then 'period ' || event_id end as period, case when value > 60 then 'decision ' || event_id end as decision from events)
select user_id, event_type, min(us) as first, max(us) as last, cast(bit_or(flag) as bigint) as flags, arg_min(period, {'a': us, 'i': event_id}) filter (period is not null) as period, arg_min(decision, {'a': us, 'i': event_id}) filter (decision is not null) as decision,
min(us) filter (decision is not null) as decision_at, case when max(us) + 4 * 86400000000 < (select max(us) - 86400000000 from e) then 'closed' else 'open' end as status from e group by 1, 2
""")
def request_inventory(spark: SparkSession, d: str) -> DataFrame:
    """STR-01, STR-02: requests collected over daily lists by a stream with state by key and timers."""
    stream = _sightings(spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet"))  # a pattern: a stream takes no single file
    found = inventory.inventory(stream, ["user_id", "event_type"], "ts", "event_id", "flags", ["period", "decision"], late="1 day", stale_days=4)
    return found.select("user_id", "event_type", "first", "last", "flags", "period", "decision", "decision_at", "status")


@query("""
with e as (select l_orderkey as k, l_returnflag as grp, cast(l_extendedprice as decimal(18,2)) as amount, l_partkey * 10 + l_linenumber as stated, cast(l_shipdate as date) as day from lineitem),
k as (select k, max({'s': stated, 'g': grp, 'a': amount}) as s from e group by 1),
n as (select k, s.g as grp, s.a as amount from k)
select grp, count(*) as n, cast(sum(amount) as double) as total from n group by 1
""")
def revised_totals(spark: SparkSession, d: str) -> DataFrame:
    """STR-06: statements of amounts that later ones correct, taken in by a stream in batches; totals take the old amount back."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("stated"), F.col("l_shipdate").cast("date").alias("day")
    )
    home = scratch.folder(spark, "revisions")
    files = max(1, -(-rows.count() // (4 * FILE_ROWS)))
    rows.repartitionByRange(4 * files, "day").write.parquet(f"{home}/in")  # four batches, so that statements meet earlier ones
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{home}/in")
    totals = Versions(spark, f"{home}/table")
    revisions.keep_revised(stream, totals, f"{home}/checkpoint", 8)
    return revisions.rollup(totals).select("grp", "n", F.col("total").cast("double").alias("total"))


@query("""
with s as (select o_custkey, max(o_totalprice) as largest from orders where o_orderpriority = '1-URGENT' group by 1)
select 'first' as version, count(*) as n, cast(0 as bigint) as stamped, cast(null as double) as largest from customer
union all select 'after a failed write', count(*), 0, null from customer
union all select 'published', count(*), count(largest), max(largest) from customer left join s on o_custkey = c_custkey
union all select 'pinned', count(*), 0, null from customer
""")
def stamped_versions(spark: SparkSession, d: str) -> DataFrame:
    """SNK-04: some fields of a table stamped in a new version; a write that fails before publishing shows nothing, earlier readers keep theirs."""
    held = Versions(spark, scratch.folder(spark, "stamped"))
    base = table(spark, d, "customer").withColumn("largest", F.lit(None).cast("double"))
    found = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("largest"))

    def stamp(old: DataFrame) -> DataFrame:
        return sinks.stamped(old, found, ["c_custkey"], ["largest"])

    def told(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n"), F.count("largest").alias("stamped"), F.max("largest").alias("largest")).select(F.lit(name).alias("version"), "n", "stamped", "largest")

    first = rewritten(held, lambda old: base)
    pinned = held.read(first)
    seen = [told("first", held.read())]
    held.stage(stamp(held.read()))  # written, never published
    seen.append(told("after a failed write", held.read()))
    rewritten(held, stamp)
    held.clean()
    seen += [told("published", held.read()), told("pinned", pinned)]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


def _run(stream: DataFrame, kind: str) -> DataFrame:
    """What a stream of rows without updates has written when it has read all there is."""
    home = scratch.folder(stream.sparkSession, kind)
    windows.run_available(stream, f"{home}/checkpoint", f"{home}/rows")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/rows")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
select event_type, user_id, cast(min(cast(ts as date)) as varchar) as day from events group by event_type, user_id
""")
def streamed_sightings(spark: SparkSession, d: str) -> DataFrame:
    """STR-04: each key of a recurring listing once, by a stream that forgets what the watermark has passed; its first day from what is left."""
    stream = _stream(spark, d)
    daily = _run(windows.once(stream.withColumn("day", F.col("ts").cast("date")), "40 days", "event_type", "user_id", "day"), "sightings")
    return daily.groupBy("event_type", "user_id").agg(F.min("day").cast("string").alias("day"))


@query("""
with t as (select user_id, max(value) as threshold from events where event_type = 'purchase' group by 1)
select event_id, e.user_id, round(value / threshold, 6) as share from events e join t using (user_id) where event_type = 'error' and value >= threshold
""")
def streamed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """STR-08: live readings that reach their place's past peak, a stream joined with a static table."""
    peaks = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("threshold"))
    found = _run(windows.alerts(_stream(spark, d).where("event_type = 'error'").select("event_id", "user_id", "value"), peaks, "user_id"), "alerts")
    return found.select("event_id", "user_id", F.round("share", 6).alias("share"))


@query("""
with e as (select user_id % 10 as region, cast(ts as date) as day, value from events where event_type = 'purchase'), n as (select max(day) as newest from e),
a as (select region, unnest(generate_series(newest - 13, newest, interval 1 day))::date as day from (select distinct region from e), n),
r as (select a.region, a.day, count(value) as n, coalesce(cast(sum(cast(value as decimal(18,2))) as double), 0) as amount from a left join e on e.region = a.region and e.day = a.day group by 1, 2)
select region, cast(day as varchar) as day, n, amount, cast(sum(n) over (partition by region order by day rows between 6 preceding and current row) as bigint) as week from r
""")
def trailing_feed(spark: SparkSession, d: str) -> DataFrame:
    """STR-05: the last 14 days of a feed by region, days without rows as 0, each with the count of the week that it ends; rebuilt from the table each day."""
    e = table(spark, d, "events").where("event_type = 'purchase'").select((F.col("user_id") % 10).alias("region"), F.col("ts").cast("date").alias("day"), "value")
    newest = e.agg(F.max("day").alias("newest"))
    regions = e.select("region").distinct().join(F.broadcast(newest))  # one row
    axis = regions.select("region", F.explode(F.sequence(F.date_sub("newest", 13), F.col("newest"))).alias("day"))
    daily = e.groupBy("region", "day").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("amount"))
    feed = axis.join(daily, ["region", "day"], "left").select("region", "day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
    week = Window.partitionBy("region").orderBy("day").rowsBetween(-6, 0)  # 14 rows a region
    return feed.select("region", F.col("day").cast("string").alias("day"), "n", "amount", F.sum("n").over(week).alias("week"))


@query("""
select 'orders' as name, count(*) as written, null as broken from orders
union all select 'customer', 0, count(*) from customer where c_acctbal < 0
union all select 'customer in credit', count(*), null from customer where c_acctbal >= 0
""")
def gated_writes(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03: tables that are written only if their checks find nothing; a refused one leaves no file."""
    home = scratch.folder(spark, "gated")
    customer = table(spark, d, "customer")
    given = {
        "orders": (table(spark, d, "orders"), {"without key": lambda rows: rows.where("o_orderkey is null").count()}),
        "customer": (customer, {"overdrawn": lambda rows: rows.where("c_acctbal < 0").count()}),
        "customer in credit": (customer.where("c_acctbal >= 0"), {"overdrawn": lambda rows: rows.where("c_acctbal < 0").count()}),
    }
    out = None
    for name, (rows, checks) in given.items():
        path = f"{home}/{name.replace(' ', '_')}"
        try:
            sinks.gated_write(rows, path, checks)
            seen = spark.read.parquet(path).agg(F.count("*").alias("written")).select(F.lit(name).alias("name"), "written", F.lit(None).cast("long").alias("broken"))
        except sinks.Refused as refused:
            system, at = scratch.filesystem(spark, path)
            if system.exists(at):
                raise ValueError(f"{path} was written although it was refused") from refused
            seen = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("written"), F.lit(sum(refused.broken.values())).cast("long").alias("broken"))
        out = seen if out is None else out.unionByName(seen)
    return out
