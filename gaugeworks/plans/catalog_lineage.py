"""Queries of a written lineage against what there is, and of the enriched panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import graph
from gaugeworks.sources import scratch
from gaugeworks.sources.readers import table

from . import panel
from .catalog import _day, query

_FILE = "'f' || p_partkey || '.json'"


@query(f"""
with a as (select p_partkey as id, {_FILE} as file, case when p_size > 2 then p_partkey % 100 end as producer, p_size = 1 as retired from part where p_size <> 7),
f as (select {_FILE} as file from part where p_size <> 11), s as (select p_partkey, p_partkey % 100 as t from part),
t as (select s_suppkey as id, 's' || s_suppkey as script from supplier), x as (select 's' || s_suppkey as script, s_suppkey as t from supplier where s_acctbal > -500),
src as (select n_nationkey + 1000000 as id, n_name as name, case when n_nationkey % 4 < 3 then 'd' || n_regionkey end as dictionary from nation),
dict as (select 'd' || n_regionkey as dictionary, n_name as col from nation where n_regionkey <> 4)
select 'orphan file' as rule, file as node, file as detail from f where file not in (select file from a)
union all select 'missing file', id::varchar, file from a where file not in (select file from f)
union all select 'no producer', id::varchar, file from a where producer is null and not retired
union all select 'missing script', id::varchar, script from t where script not in (select script from x)
union all select 'unknown write', t::varchar, p_partkey::varchar from s where p_partkey not in (select id from a)
union all select 'unknown read', t::varchar, id::varchar from (select s_suppkey as t, s_nationkey + 1000000 + case when s_suppkey % 9 = 0 then 50 else 0 end as id from supplier) r where id not in (select id from src)
union all select 'write not in script', s.t::varchar, file from s join a on a.id = s.p_partkey join x on x.t = s.t where s.p_partkey % 7 = 0
union all select 'read not in script', x.t::varchar, name from (select s_suppkey as t, s_nationkey + 1000000 + case when s_suppkey % 9 = 0 then 50 else 0 end as id from supplier) r join src using (id) join x on x.t = r.t where x.t % 4 = 0
union all select 'column not in dictionary', src.id::varchar, 'n' || substr(name, 2) || case when (src.id - 1000000) % 3 = 0 then 'x' else '' end from src where dictionary in (select dictionary from dict) and (src.id - 1000000) % 3 = 0
union all select 'missing dictionary', id::varchar, dictionary from src where dictionary is not null and dictionary not in (select dictionary from dict)
""")
def lineage_problems(spark: SparkSession, d: str) -> DataFrame:
    """GRF-02: files, scripts, reads, writes, sources and columns that a written lineage and the scripts themselves do not agree about."""
    part, supplier, nation = table(spark, d, "part"), table(spark, d, "supplier"), table(spark, d, "nation")
    file = F.concat(F.lit("f"), "p_partkey", F.lit(".json"))
    maker = F.col("p_partkey") % 100
    # parts and sources are numbered apart: part 1000050 is not source 1000050
    item, source = F.concat(F.lit("p"), "p_partkey"), F.concat(F.lit("n"), (F.col("n_nationkey") + 1_000_000).cast("long"))
    artifacts = part.where("p_size <> 7").select(item.alias("id"), file.alias("file"), F.when(F.col("p_size") > 2, maker).alias("producer"), (F.col("p_size") == 1).alias("retired"))
    files = part.where("p_size <> 11").select(file.alias("file"))
    transforms = supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("script"))
    writes = part.select(maker.alias("transform"), item.alias("id"))
    reads = supplier.select(F.col("s_suppkey").alias("transform"), F.concat(F.lit("n"), (F.col("s_nationkey") + 1_000_000 + F.when(F.col("s_suppkey") % 9 == 0, 50).otherwise(0)).cast("long")).alias("id"))
    sources = nation.select(source.alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 < 3, F.concat(F.lit("d"), "n_regionkey")).alias("dictionary"))
    used = nation.select(source.alias("source"), F.concat(F.lit("n"), F.substring("n_name", 2, 99), F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise("")).alias("column"))
    dictionaries = nation.where("n_regionkey <> 4").select(F.concat(F.lit("d"), "n_regionkey").alias("dictionary"), F.col("n_name").alias("column"))
    # a script names the files that it writes, but for every seventh, and the source that it reads, but for every fourth script
    named = part.where("p_partkey % 7 <> 0").groupBy(maker.alias("s_suppkey")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("write('"), file, F.lit("')")))), "; ").alias("w"))
    scripts = supplier.where("s_acctbal > -500").join(nation, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(named, "s_suppkey", "left")
    text = F.concat_ws("\n", F.coalesce("w", F.lit("")), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("read('"), "n_name", F.lit("')"))))
    found = graph.lineage_problems(artifacts, files, transforms, scripts.select(F.concat(F.lit("s"), "s_suppkey").alias("script"), text.alias("text")), writes, reads, sources, used, dictionaries)

    def number(column: str, *rules: str):
        return F.when(F.col("rule").isin(*rules), F.substr(column, F.lit(2))).otherwise(F.col(column)).alias(column)

    return found.select("rule", number("node", "missing file", "no producer", "column not in dictionary", "missing dictionary"), number("detail", "unknown write", "unknown read"))


_SITE = "l_suppkey % 50"
_EPISODES = f"""
e as (select {_SITE} as site, l_orderkey as episode, min(cast(l_shipdate as date)) as b, max(cast(l_shipdate as date)) as e, max(case when l_linenumber <= 3 then l_quantity end) as hail, sum(cast(floor(l_extendedprice) as bigint)) as damage, count(*) filter (l_linenumber >= 6) as tornadoes from lineitem group by 1, 2),
i as (select o_custkey % 50 as site, o_orderkey as dn, cast(o_orderdate as date) as ib, cast(o_orderdate as date) + cast(o_custkey % 20 as int) as ie, o_totalprice as cost from orders where o_orderstatus = 'F'),
d as (select e.site, e.episode, max({{'dn': dn, 'cost': cost}}) as m from e join i on i.site = e.site and ib <= e.e + 4 and ie >= e.b - 10 group by 1, 2),
rain as (select user_id % 50 as site, cast(ts as date) - 8766 as day, max(value) as v from events group by 1, 2)
"""


def _episodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Line items as storm records of 50 counties, one episode an order, with ``columns`` of the panel; incidents are settled orders of the same county."""
    n = F.col("l_linenumber")
    site = F.lpad((F.col("l_suppkey") % 50).cast("string"), 5, "0")
    storms = table(spark, d, "lineitem").select(
        site.alias("fips"), F.substring(site, 4, 1).alias("state"), F.col("l_orderkey").alias("episode"), F.when(n <= 3, "Hail").when(n >= 6, "Tornado").otherwise("Heavy Snow").alias("event_type"), F.col("l_quantity").alias("magnitude"), F.lit("EG").alias("magnitude_type"),
        F.lit(1).alias("scale"), F.floor("l_extendedprice").cast("double").alias("damage"), _day("l_shipdate").alias("begin_date"), F.lit(False).alias("zoned"),
    )
    o, day = table(spark, d, "orders").where("o_orderstatus = 'F'"), _day("o_orderdate")
    incidents = o.select(F.lpad((F.col("o_custkey") % 50).cast("string"), 5, "0").alias("fips"), F.col("o_orderkey").alias("dn"), day.alias("incident_begin"), F.date_add(day, (F.col("o_custkey") % 20).cast("int")).alias("incident_end"), F.col("o_totalprice").alias("cost"))
    # read for its spans and for its rows: computed once
    return panel.declared(scratch.written(panel.episodes(storms).select("fips", "episode", "begin", "end", *columns), "episodes"), incidents)


@query(f"""
with {_EPISODES},
w as (select e.site, e.episode, max(v) filter (day >= b) as most, sum(v) filter (day >= b) as during, sum(v) filter (day between b - 7 and b - 1) as before7, sum(v) filter (day between b - 14 and b - 1) as before14, count(*) filter (day >= b) as seen, max(floor(v)) filter (day < b) as deep from e join rain r on r.site = e.site and day between b - 14 and least(e.e, b + 30) group by 1, 2),
p as (select e.site, e.episode, day, v, b from e join rain r on r.site = e.site and day between b - 14 and least(e.e, b + 30)),
m as (select p.site, p.episode, max(greatest(floor(p.v) - floor(q.v), 0)) filter (p.day >= p.b - 4) as melt from p left join p q on q.site = p.site and q.episode = p.episode and q.day = p.day + 1 group by 1, 2)
select lpad(cast(e.site as varchar), 5, '0') as fips, e.episode, cast(e.damage as bigint) as damage, m1.m['dn'] as dn, cast(m1.m['dn'] is not null as int) as declared, round(m1.m['cost'], 2) as cost, round(most, 2) as rain_day_max, round(case when w.site is not null then coalesce(during, 0) end, 2) as rain_event, round(case when w.site is not null then coalesce(before7, 0) end, 2) as rain_before_7, round(case when w.site is not null then coalesce(before14, 0) end, 2) as rain_before_14, seen as rain_days_seen,
case when month(e.b) in (12, 1, 2, 3, 4) then deep else 0 end as snow_depth_before, case when month(e.b) in (12, 1, 2, 3, 4) then melt else 0 end as snow_melt
from e left join d m1 on m1.site = e.site and m1.episode = e.episode left join w on w.site = e.site and w.episode = e.episode left join m on m.site = e.site and m.episode = e.episode
""")
def enriched_panel(spark: SparkSession, d: str) -> DataFrame:
    """The county panel with its labels, event and antecedent rain, snow before and melt; readings are dated 24 years back, onto the episodes."""
    site = F.lpad((F.col("user_id") % 50).cast("string"), 5, "0")
    daily = table(spark, d, "events").groupBy(site.alias("fips"), F.date_sub(_day("ts"), 8766).alias("day")).agg(F.max("value").alias("mean"))
    rain, depth = daily.withColumn("most", F.col("mean")), daily.select("fips", "day", F.floor("mean").cast("double").alias("depth"))
    out = panel.with_snow(panel.with_rain(_episodes(spark, d, "damage"), rain), depth)
    return out.select("fips", "episode", "damage", "dn", "declared", F.round("cost", 2).alias("cost"), "rain_day_max", "rain_event", "rain_before_7", "rain_before_14", "rain_days_seen", "snow_depth_before", "snow_melt")


@query(f"""
with {_EPISODES},
p as (select e.*, lpad(cast(e.site as varchar), 5, '0') as fips, substr(lpad(cast(e.site as varchar), 5, '0'), 4, 1) as state, m['dn'] as dn from e left join d using (site, episode)),
k as (select state, episode, dn, count(*) as n, min(site) as f from p where dn is not null group by 1, 2, 3), t as (select state, episode, arg_max(dn, {{'n': n, 'f': -f}}) as dn from k group by 1, 2)
select p.state, p.episode, cast(min(b) as varchar) as begin, cast(max(e) as varchar) as "end", count(*) as counties, cast(sum(damage) as bigint) as damage, cast(sum(tornadoes) as bigint) as tornadoes, max(coalesce(hail, 0)) as hail, any_value(t.dn) as dn, cast(any_value(t.dn) is not null as int) as declared from p left join t on t.state = p.state and t.episode = p.episode group by 1, 2
""")
def state_panel_rows(spark: SparkSession, d: str) -> DataFrame:
    """The panel by state and episode, with the incident that most of its counties have."""
    out = panel.state_panel(_episodes(spark, d, "state", "damage", "tornadoes", "ef", "gust", "hail", "flood", "winter"))
    return out.select("state", "episode", F.col("begin").cast("string").alias("begin"), F.col("end").cast("string").alias("end"), "counties", "damage", "tornadoes", "hail", "dn", "declared")
