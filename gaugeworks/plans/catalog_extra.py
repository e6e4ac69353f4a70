"""Queries for the rest of the inventory: candidates with tie-breaks, nested aggregates, shapes, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import classify, names
from gaugeworks.operators import aggregates, joins, sinks
from gaugeworks.operators.ranges import running
from gaugeworks.sources.readers import table

from .catalog import _day, query


@query("""
with o as (select *, cast(o_orderdate as date) as day, list_distinct(regexp_extract_all(lower(o_orderpriority), '[a-z]+')) as t from orders),
c as (select a.o_orderkey as i, b.o_orderkey as j, len(list_intersect(a.t, b.t)) > 0 as share from o a join o b on b.o_custkey = a.o_custkey and abs(b.day - a.day) <= 60 where a.o_orderstatus = 'F' and b.o_orderstatus = 'O'),
k as (select i, count(*) as n, count(*) filter (share) as ns, max(j) as any_j, max(j) filter (share) as share_j from c group by 1)
select i, n, case when n = 1 then any_j when ns = 1 then share_j end as j from k
""")
def candidate_by_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-12: a closed order and the customer's open ones within sixty days; several are decided by the only one that shares a word."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", _day("o_orderdate").alias("day"), F.array_distinct(names.words(F.col("o_orderpriority"))).alias("t"))
    a = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("i"), "day", "t")
    b = orders.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("j"), F.col("day").alias("seen"), F.col("t").alias("u"))
    share = F.arrays_overlap("t", "u")
    # both meet by customer and stretch of days, so a hot customer's orders are not all paired
    a = a.withColumn("_s", F.explode(joins.stretches(F.date_sub("day", 60), F.date_add("day", 60), 64)))
    b = b.withColumn("_s", F.floor(F.datediff("seen", F.lit("1970-01-01").cast("date")) / 64).cast("int"))
    k = a.join(b, ["o_custkey", "_s"]).where(F.abs(F.datediff("seen", "day")) <= 60).groupBy("i").agg(F.count("*").alias("n"), F.count_if(share).alias("ns"), F.max("j").alias("any_j"), F.max(F.when(share, F.col("j"))).alias("share_j"))
    return k.select("i", "n", F.when(F.col("n") == 1, F.col("any_j")).when(F.col("ns") == 1, F.col("share_j")).alias("j"))


@query("""
with c as (select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as cost from orders group by 1)
select 'costed' as kind, count(*) as n from customer join c on o_custkey = c_custkey union all select 'identity_only', count(*) from customer where c_custkey not in (select o_custkey from c) union all select 'orphan', count(*) from c where o_custkey not in (select c_custkey from customer)
""")
def identities_and_orphans(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-13, AUD-09: identities with and without costs, costs without identity, in one full join."""
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(True).alias("known"))
    costs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(aggregates.exact_sum("o_totalprice").alias("cost"))
    kind = classify.first_matching([(F.col("known") & F.col("cost").isNotNull(), "costed"), (F.col("known"), "identity_only")], "orphan")
    found = ids.join(costs, "k", "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([("costed",), ("identity_only",), ("orphan",)], "kind string")
    return every.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
with x as (select l.toxic, d.n_chars from documents d join labels l using (doc_id)), v as (select distinct n_chars from x)
select v.n_chars as at_least, (select count(*) from x where x.n_chars >= v.n_chars) as n, (select count(*) from x where x.n_chars >= v.n_chars and toxic = 1) as positives from v
""")
def counts_at_least(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-19: rows and positives at or above every value, by a running count instead of a theta join."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    by = rows.groupBy(F.col("n_chars").alias("at_least")).agg(F.count("*").alias("c"), F.count_if(F.col("toxic") == 1).alias("p"))
    return running(by, (), "at_least", ["c", "p"], descending=True).select("at_least", F.col("c_upto").alias("n"), F.col("p_upto").alias("positives"))


@query("""
with t as (select s_nationkey, l_suppkey, l_returnflag, sum(l_quantity) as total, max(l_quantity) as most from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3),
c as (select s_nationkey, l_returnflag, max(total) as county_max, avg(total) as county_mean, max(most) as most from t group by 1, 2)
select s_nationkey, max(county_max) as highest, round(avg(county_mean), 6) as mean_of_means, max(most) as most from c group by 1
""")
def nested_station_totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23, AGG-37: totals of stations, then of counties, then of the whole."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    station = rows.groupBy("s_nationkey", "l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("total"), F.max("l_quantity").alias("most"))
    county = station.groupBy("s_nationkey", "l_returnflag").agg(F.max("total").alias("county_max"), F.avg("total").alias("county_mean"), F.max("most").alias("most"))
    return county.groupBy("s_nationkey").agg(F.max("county_max").alias("highest"), F.round(F.avg("county_mean"), 6).alias("mean_of_means"), F.max("most").alias("most"))


@query("""
with y as (select o_custkey, extract(year from o_orderdate) as year, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders group by 1, 2)
select o_custkey, array_to_string(list(year || ':' || round(amount)::bigint order by year), ' ') as years, cast(count(*) as bigint) as n from y group by 1
""")
def year_maps(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18: a tall sum by year, folded to one map for each key at the end."""
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(aggregates.exact_sum("o_totalprice").alias("amount"))
    pair = F.struct("year", F.concat_ws(":", F.col("year").cast("string"), F.round("amount").cast("long").cast("string")).alias("text"))
    return y.groupBy("o_custkey").agg(F.sort_array(F.collect_list(pair)).alias("p"), F.count("*").alias("n")).select("o_custkey", F.array_join("p.text", " ").alias("years"), "n")


@query("""
select o_custkey, max(o_orderkey) filter (r = 1) as o_orderkey, max(o_orderpriority) filter (r = 1) as o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) group by 1
""")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, AGG-40: the newest row of a key, later rows win ties."""
    last = F.max_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(last.alias("l")).select("o_custkey", "l.*")


@query("""
with d as (select user_id, cast(ts as date) as day, max(value) as v, count(distinct extract(hour from ts)) as hours from events group by 1, 2) select user_id, count(*) filter (v >= 60) * 24 as day_hours, cast(sum(case when v >= 60 then hours else 0 end) as bigint) as seen_hours from d group by 1
""")
def hours_above(spark: SparkSession, d: str) -> DataFrame:
    """WIN-13: days above a level as hours, and the hours with a reading on them."""
    days = table(spark, d, "events").groupBy("user_id", _day("ts").alias("day")).agg(F.max("value").alias("v"), F.count_distinct(F.hour("ts")).alias("hours"))
    return days.groupBy("user_id").agg((F.count_if(F.col("v") >= 60) * 24).alias("day_hours"), F.sum(F.when(F.col("v") >= 60, F.col("hours")).otherwise(F.lit(0))).cast("long").alias("seen_hours"))


@query("""
select c_custkey, case when c_acctbal < 0 then 'below' when c_acctbal < 2500 then 'action' when c_acctbal < 5000 then 'minor' when c_acctbal < 7500 then 'moderate' else 'major' end as category, round(greatest(coalesce(nullif(c_acctbal, 0) - 500, 0), 0), 2) as over from customer
""")
def stage_categories(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-19, PRJ-24, PRJ-25: the highest threshold reached and the clamped excess."""
    x = F.col("c_acctbal")
    category = classify.first_matching([(x < 0, "below"), (x < 2500, "action"), (x < 5000, "minor"), (x < 7500, "moderate")], "major")
    return table(spark, d, "customer").select("c_custkey", category.alias("category"), F.round(F.greatest(F.coalesce(F.nullif(x, F.lit(0.0)) - 500, F.lit(0.0)), F.lit(0.0)), 2).alias("over"))


@query("""
select o_orderkey, array_to_string(list_filter([case when o_totalprice > 200000 then 'Large' end, case when o_orderpriority like '1-%' then 'Urgent' end, case when o_orderstatus = 'F' then 'Closed' end], lambda x: x is not null), ',') as tags from orders
""")
def ordered_tags(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-15: several labels in a fixed order."""
    rules = [(F.col("o_totalprice") > 200000, "Large"), (F.col("o_orderpriority").startswith("1-"), "Urgent"), (F.col("o_orderstatus") == "F", "Closed")]
    return table(spark, d, "orders").select("o_orderkey", F.array_join(classify.tags(rules), ",").alias("tags"))


@query("""
select o_orderkey, case when o_orderpriority = '1-URGENT' and o_orderstatus <> 'F' then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderstatus <> 'P' union all select o_orderkey, o_orderstatus from orders where o_orderstatus = 'P' and o_totalprice >= 250000
""")
def stamped_and_inserted(spark: SparkSession, d: str) -> DataFrame:
    """SNK-04, SNK-05: fields stamped onto known keys, unknown keys appended."""
    orders = table(spark, d, "orders")
    old = orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    marks = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus <> 'F'").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    new = orders.where("o_totalprice >= 250000").select("o_orderkey", "o_orderstatus")
    return sinks.inserted(sinks.stamped(old, marks, ["o_orderkey"], ["o_orderstatus"]), new, ["o_orderkey"])


@query("""
with a as (select s_suppkey, s_name, s_nationkey from supplier where s_acctbal < 8000), b as (select s_suppkey, case when s_nationkey = 3 then 'changed' else s_name end as s_name, s_nationkey from supplier where s_acctbal >= 1000)
select *, 'left' as side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)
""")
def differing_rows(spark: SparkSession, d: str) -> DataFrame:
    """SNK-07, SET-06: what two versions of a table do not share."""
    s, columns = table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"]
    changed = s.where("s_acctbal >= 1000").withColumn("s_name", F.when(F.col("s_nationkey") == 3, "changed").otherwise(F.col("s_name")))
    return sinks.differing(s.where("s_acctbal < 8000").select(*columns), changed.select(*columns))


@query("""
with t as (select n_name, c_mktsegment, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2),
p as (select *, row_number() over (partition by n_name order by amount desc, c_mktsegment) as r from t)
select n_name, max(c_mktsegment) filter (r = 1) as first, max(c_mktsegment) filter (r = 2) as second, round(max(amount) / sum(amount), 6) as lead_share from p group by 1
""")
def top_two_profile(spark: SparkSession, d: str) -> DataFrame:
    """AGG-41: the two leading classes of a state and the leader's share."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    t = rows.groupBy("n_name", "c_mktsegment").agg(aggregates.exact_sum("o_totalprice").alias("amount"))
    ranked = t.withColumn("r", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("amount"), "c_mktsegment")))
    return ranked.groupBy("n_name").agg(F.max(F.when(F.col("r") == 1, F.col("c_mktsegment"))).alias("first"), F.max(F.when(F.col("r") == 2, F.col("c_mktsegment"))).alias("second"), F.round(F.max("amount") / F.sum("amount"), 6).alias("lead_share"))


@query("""
with m as (select o_custkey, median(o_totalprice) as med from orders group by 1), t as (select c_nationkey, round(sum(med), 4) as typical, count(*) as n from m join customer on c_custkey = o_custkey group by 1)
select *, round(n / avg(n) over () - 1, 6) as load from t
""")
def medians_and_load(spark: SparkSession, d: str) -> DataFrame:
    """DOC-08, DOC-09: sums of medians, and each team's load against the average."""
    m = aggregates.percentiles(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", {"med": 0.5})
    t = m.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.round(F.sum("med"), 4).alias("typical"), F.count("*").alias("n"))
    mean = t.agg(F.avg("n").alias("mean"))
    return t.crossJoin(F.broadcast(mean)).select("c_nationkey", "typical", "n", F.round(F.col("n") / F.col("mean") - 1, 6).alias("load"))  # one row


@query("""
select s_suppkey, case when s_suppkey % 4 = 0 then 'static' when s_suppkey % 5 = 0 then 'unknown' when s_suppkey % 97 <= (s_suppkey % 9) + greatest(s_suppkey % 9, 7) then 'fresh' when s_suppkey % 97 <= 5 * (s_suppkey % 9) then 'aging' else 'stale' end as state from supplier
""")
def freshness_classes(spark: SparkSession, d: str) -> DataFrame:
    """DOC-17, GRF-04: age against cadence."""
    k = F.col("s_suppkey")
    state = classify.freshness(F.when(k % 5 != 0, k % 97), F.when(k % 4 != 0, k % 9))
    return table(spark, d, "supplier").select("s_suppkey", state.alias("state"))


@query("""
with t as (select event_type, cast(ts as date) as day, value from events), m as (select event_type, max(day) as newest, min(day) as oldest from t group by 1)
select event_type, cast(newest as varchar) as newest, cast(oldest as varchar) as oldest, (select count(*) from t where t.event_type = m.event_type and t.day > m.newest - 7) as last_week from m
""")
def newest_and_recent(spark: SparkSession, d: str) -> DataFrame:
    """AGG-33, WIN-17: newest day of a class and the rows of the week that ends on it."""
    t = table(spark, d, "events").select("event_type", _day("ts").alias("day"))
    m = t.groupBy("event_type").agg(F.max("day").alias("newest"), F.min("day").alias("oldest"))
    recent = t.join(m, "event_type").where(F.col("day") > F.date_sub("newest", 7)).groupBy("event_type").agg(F.count("*").alias("last_week"))
    return m.join(recent, "event_type").select("event_type", F.col("newest").cast("string").alias("newest"), F.col("oldest").cast("string").alias("oldest"), "last_week")


@query("""
select case when c_acctbal < 0 then 'negative' when c_acctbal = 0 then 'zero' else 'positive' end as sign, count(*) as n, count(*) filter (round(c_acctbal / 1000, 2) >= 5) as large, cast(sum(cast(greatest(c_acctbal, 0) as decimal(18,2))) as double) as clamped from customer group by 1
""")
def clamped_amounts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-16, FLT-17, PRJ-09: signs kept apart, negatives clamped only where asked."""
    x = F.col("c_acctbal")
    sign = classify.first_matching([(x < 0, "negative"), (x == 0, "zero")], "positive")
    return table(spark, d, "customer").groupBy(sign.alias("sign")).agg(F.count("*").alias("n"), F.count_if(F.round(x / 1000, 2) >= 5).alias("large"), aggregates.exact_sum(F.greatest(x, F.lit(0.0))).alias("clamped"))


@query("""
select doc_id, length(text) as n, len(string_split(text, chr(10))) as lines, md5(text) as digest from documents
""")
def text_digests(spark: SparkSession, d: str) -> DataFrame:
    """SRC-27: sizes and digests of whole texts."""
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"), F.md5("text").alias("digest"))
