"""Queries for window peaks, bridges with misses, small dimensions, pivots, aligned series and footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import classify
from gaugeworks.operators import aggregates, similarity
from gaugeworks.sources.readers import table

from .catalog import _day, query


@query("""
with w as (select o_orderkey, o_orderpriority, l_linenumber, l_quantity, cast(l_shipdate as date) as day, row_number() over (partition by o_orderkey order by l_quantity desc, l_shipdate, l_linenumber) as r
from orders join lineitem on l_orderkey = o_orderkey where cast(l_shipdate as date) between cast(o_orderdate as date) - 4 and cast(o_orderdate as date) + 45 and l_returnflag in ('A', 'R'))
select o_orderkey, l_linenumber, l_quantity as peak, cast(day as varchar) as day from w where r = 1 and l_quantity >= case when o_orderpriority = '1-URGENT' then 20 else 35 end
""")
def window_peak_record(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-05: the largest reading in each padded window, the earliest of equals, where it reaches the threshold."""
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    day, begin = _day("l_shipdate"), _day("o_orderdate")
    rows = rows.where(day.between(F.date_sub(begin, 4), F.date_add(begin, 45)) & F.col("l_returnflag").isin("A", "R"))
    order = F.struct(F.col("l_quantity"), -F.unix_micros(F.col("l_shipdate").cast("timestamp")), -F.col("l_linenumber"))
    best = rows.groupBy("o_orderkey", "o_orderpriority").agg(F.max_by(F.struct("l_linenumber", F.col("l_quantity").alias("peak"), day.cast("string").alias("day")), order).alias("b"))
    least = F.when(F.col("o_orderpriority") == "1-URGENT", 20).otherwise(35)
    return best.where(F.col("b.peak") >= least).select("o_orderkey", "b.*")


@query("""
with s as (select * from supplier where s_acctbal > 0), n as (select * from nation where n_regionkey <> 2)
select case when s_suppkey is null then 'no first hop' when n_nationkey is null then 'no second hop' else n_name end as place, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount
from lineitem left join s on s_suppkey = l_suppkey left join n on n_nationkey = s_nationkey group by 1
""")
def two_hop_bridge(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-09: facts reach their place over two tables; the misses of each hop are counted."""
    first = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    second = table(spark, d, "nation").where("n_regionkey <> 2").select("n_nationkey", "n_name")
    bridge = first.join(second, "n_nationkey", "left").select("l_suppkey", F.coalesce("n_name", F.lit("no second hop")).alias("place"))
    rows = table(spark, d, "lineitem").join(bridge, "l_suppkey", "left")
    return rows.groupBy(F.coalesce("place", F.lit("no first hop")).alias("place")).agg(F.count("*").alias("n"), aggregates.exact_sum("l_extendedprice").alias("amount"))


#: Durations listed for JOIN-23.
_DURATIONS = (1, 2, 3, 5, 10, 20, 30, 45)


@query("""
with x as (select p_partkey, p_size, unnest([1, 2, 3, 5, 10, 20, 30, 45]) as dur from part)
select p_partkey, cast(arg_min(dur, abs(dur - p_size) * 1000 + dur) as int) as duration from x group by 1
""")
def nearest_duration(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-23: the listed duration next to a length, the smaller of two equally near; no join at all."""
    near = F.array_min(F.array(*(F.struct(F.abs(F.col("p_size") - k).alias("gap"), F.lit(k).alias("duration")) for k in _DURATIONS)))
    return table(spark, d, "part").select("p_partkey", near["duration"].alias("duration"))


@query("""
select l_suppkey, case when r > 0 then r else a end as price, case when r > 0 then 'returned' when a is not null then 'accepted' end as source
from (select s_suppkey as l_suppkey, max(l_extendedprice) filter (l_returnflag = 'R' and l_linestatus = 'F') as r, max(l_extendedprice) filter (l_returnflag = 'A') as a from supplier left join lineitem on l_suppkey = s_suppkey group by 1)
""")
def fallback_source(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-27, JOIN-30: keys that the first source lacks take their value from the second; one pass over both."""
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    found = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.when((flag == "R") & (F.col("l_linestatus") == "F"), price)).alias("r"), F.max(F.when(flag == "A", price)).alias("a"))
    every = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")).join(found, "l_suppkey", "left")
    return every.select("l_suppkey", F.when(F.col("r") > 0, F.col("r")).otherwise(F.col("a")).alias("price"), classify.first_matching([(F.col("r") > 0, "returned"), (F.col("a").isNotNull(), "accepted")], None).alias("source"))


@query("""
with r as (select *, row_number() over (partition by p_brand order by length(p_name) desc, p_name) as r from part)
select p_brand, max(p_name) filter (r = 1) as title, min(p_size) as first_size, bool_or(p_retailprice > 1000) as any_dear, count(distinct p_type) as types from r group by 1
""")
def longest_and_earliest(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08: longest name (ties by the alphabet), least size and flags of each key, without a window."""
    shortest = F.min_by("p_name", F.struct(-F.length("p_name"), F.col("p_name")))
    return table(spark, d, "part").groupBy("p_brand").agg(shortest.alias("title"), F.min("p_size").alias("first_size"), F.bool_or(F.col("p_retailprice") > 1000).alias("any_dear"), F.count_distinct("p_type").alias("types"))


@query("""
select n_name, count(*) as lines, count(*) filter (l_returnflag = 'R') as returned, count(*) filter (l_discount >= 0.08) as discounted, count(*) filter (l_quantity >= 45) as bulk from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1
""")
def state_by_hazard(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15: overlapping classes by state; a row counts in each class it has."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") >= 0.08).alias("discounted"), F.count_if(F.col("l_quantity") >= 45).alias("bulk"))


@query("""
with b as (select case when o_totalprice < 10000 then '0' when o_totalprice < 100000 then '1' when o_totalprice < 400000 then '2' else '3' end as band, o_orderstatus = 'F' as f from orders)
select band, count(*) as n, count(*) filter (f) as declared, round(count(*) filter (f) / cast(count(*) as double), 3) as rate from b group by 1 having count(*) >= 10
""")
def damage_band_rates(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, AGG-16: rates by band, bands of few rows left out."""
    x, closed = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
    band = classify.first_matching([(x < 10000, "0"), (x < 100000, "1"), (x < 400000, "2")], "3")
    counted = table(spark, d, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(closed).alias("declared")).where("n >= 10")
    return counted.withColumn("rate", F.round(F.col("declared") / F.col("n"), 3))


@query("""
with a as (select date_trunc('month', o_orderdate)::date as month, count(*) as orders, cast(max(o_totalprice) as double) as dearest from orders group by 1),
b as (select date_trunc('month', l_shipdate)::date as month, cast(sum(cast(l_quantity as decimal(18,2))) as double) as shipped from lineitem group by 1)
select cast(month as varchar) as month, orders, dearest, shipped from a full join b using (month)
""")
def aligned_months(spark: SparkSession, d: str) -> DataFrame:
    """AGG-27: several monthly series on one axis, null where one has no month."""
    a = table(spark, d, "orders").groupBy(F.trunc(_day("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("dearest"))
    b = table(spark, d, "lineitem").groupBy(F.trunc(_day("l_shipdate"), "month").alias("month")).agg(aggregates.exact_sum("l_quantity").alias("shipped"))
    return a.join(b, "month", "full").withColumn("month", F.col("month").cast("string"))


@query("""
with g as (select l_returnflag, cast(l_shipdate as date) - cast(o_orderdate as date) as gap from lineitem join orders on l_orderkey = o_orderkey)
select l_returnflag, count(*) as n, count(*) filter (gap = 30) as exact, count(*) filter (abs(gap - 30) <= 3) as within_3, round(avg(abs(gap - 30)), 2) as mean_off from g group by 1
""")
def gap_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-30: how far dates lie from where they are expected."""
    gap = F.datediff(_day("l_shipdate"), _day("o_orderdate")) - 30
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", gap.alias("off"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("off") == 0).alias("exact"), F.count_if(F.abs("off") <= 3).alias("within_3"), F.round(F.avg(F.abs("off")), 2).alias("mean_off"))


@query("""
select c_nationkey, count(*) as n, count(*) filter (c_acctbal > 0) as n_positive, round(quantile_cont(c_acctbal, 0.5) filter (c_acctbal > 0), 4) as median, round(quantile_cont(c_acctbal, 0.9) filter (c_acctbal > 0), 4) as p90, max(c_acctbal) filter (c_acctbal > 0) as most from customer group by 1
""")
def positive_cost_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-38: median, ninth decile and maximum of the positive values only."""
    rows = table(spark, d, "customer").withColumn("x", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    ends = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count("x").alias("n_positive"), F.max("x").alias("most"))
    middle = aggregates.percentiles(rows, ["c_nationkey"], "x", {"median": 0.5, "p90": 0.9}).drop("n")
    return ends.join(middle, "c_nationkey").select("c_nationkey", "n", "n_positive", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), "most")


@query("""
with f as (select distinct o_custkey, l_suppkey from orders join lineitem on l_orderkey = o_orderkey),
m as (select q.o_custkey as query, e.o_custkey as other, count(*) as shared from f q join f e on e.l_suppkey = q.l_suppkey and e.o_custkey <> q.o_custkey where q.o_custkey % 100 = 0 group by 1, 2)
select query, other, shared, rank from (select *, cast(row_number() over (partition by query order by shared desc, other) as int) as rank from m) where rank <= 5
""")
def footprint_analogs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-29: customers whose suppliers overlap most with those of a stated query set, five each."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return similarity.most_shared(rows, "o_custkey", "l_suppkey", F.col("o_custkey") % 100 == 0, 5)


@query("""
with w as (select p_partkey, p_name, unnest(['red', 'blue', 'hot', 'small', 'ring', 'gear']) as word, unnest([1, 2, 3, 4, 5, 6]) as ord from part)
select p_partkey, arg_min(word, ord) filter (contains(p_name, word)) as word from w group by 1
""")
def first_contained_word(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-24: the first listed word that a name contains, null without one; a short list is an expression, not a join."""
    words = ("red", "blue", "hot", "small", "ring", "gear")
    return table(spark, d, "part").select("p_partkey", classify.first_matching([(F.col("p_name").contains(w), w) for w in words], None).alias("word"))


@query("""
with m as (select l_suppkey, case when avg(l_quantity) < 24.5 then 0 when avg(l_quantity) < 25.5 then 1 when avg(l_quantity) < 26.5 then 2 else 3 end as bin, case when 20 * count(*) filter (l_discount >= 0.1) >= count(*) then 1 else 0 end as declared from lineitem where l_returnflag <> 'N' group by 1),
k as (select s_nationkey, bin, count(*) as n, sum(declared) as d from m join supplier on s_suppkey = l_suppkey group by 1, 2)
select s_nationkey, bin, n, cast(sum(n) over (partition by s_nationkey) as bigint) as pool, round(d / cast(n as double), 3) as rate from k
""")
def pooled_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-42: a parameter's bins within each state's pool and the declared share of every bin."""
    mean = F.avg("l_quantity")
    bins = F.when(mean < 24.5, 0).when(mean < 25.5, 1).when(mean < 26.5, 2).otherwise(3)
    m = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy("l_suppkey").agg(bins.alias("bin"), F.when(20 * F.count_if(F.col("l_discount") >= 0.1) >= F.count("*"), 1).otherwise(0).alias("declared"))
    k = m.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey", "bin").agg(F.count("*").alias("n"), F.sum("declared").alias("declared"))
    pool = F.sum("n").over(Window.partitionBy("s_nationkey"))
    return k.select("s_nationkey", "bin", "n", pool.alias("pool"), F.round(F.col("declared") / F.col("n"), 3).alias("rate"))
