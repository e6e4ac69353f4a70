"""Queries of landed documents: storm rows, crosswalks, listings, feature pages, map shapes, printed dates, forced merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import geometry, parsing
from gaugeworks.operators import linkage
from gaugeworks.sources import readers
from gaugeworks.sources.readers import table

from .catalog import _day, query


@query("""
select l_orderkey, lpad(cast(l_suppkey % 57 as varchar), 2, '0') as state, l_linestatus as zone_type, lpad(cast(l_linenumber as varchar), 3, '0') as zone, 'Cook ' || l_returnflag as zone_name, 'Hail' as event_type, case when l_linenumber <> 1 then l_orderkey end as episode,
strftime(l_shipdate, '%Y-%m-%d') as begin_date, l_quantity as magnitude, case when l_linenumber <> 2 then cast(l_linenumber % 6 as int) end as scale, floor(l_quantity) * case when l_linenumber % 2 = 0 then 1000.0 else 1000000.0 end as damage from lineitem where l_suppkey % 57 < 30
""")
def storm_file_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01, SRC-02, FLT-01: text columns of storm files, typed; only the wanted states."""
    n, k = F.col("l_linenumber"), F.col("l_suppkey") % 57
    text = table(spark, d, "lineitem").select(
        k.cast("string").alias("STATE_FIPS"), F.col("l_linestatus").alias("CZ_TYPE"), n.cast("string").alias("CZ_FIPS"), F.concat(F.lit(" COOK "), "l_returnflag").alias("CZ_NAME"), F.lit("Hail ").alias("EVENT_TYPE"),
        F.when(n != 1, F.col("l_orderkey").cast("string")).otherwise("").alias("EPISODE_ID"), F.date_format("l_shipdate", "yyyyMM").alias("BEGIN_YEARMONTH"), F.dayofmonth("l_shipdate").cast("string").alias("BEGIN_DAY"),
        F.col("l_quantity").cast("string").alias("MAGNITUDE"), F.col("l_orderkey").cast("string").alias("MAGNITUDE_TYPE"), F.when(n != 2, F.concat(F.lit("EF"), (n % 6).cast("string"))).otherwise("EFU").alias("TOR_F_SCALE"),
        F.concat(F.floor("l_quantity").cast("string"), F.when(n % 2 == 0, "K").otherwise("M")).alias("DAMAGE_PROPERTY"),
    )
    rows = readers.storm_rows(text, [f"{s:02d}" for s in range(30)])
    return rows.select(F.col("magnitude_type").cast("long").alias("l_orderkey"), "state", "zone_type", "zone", "zone_name", "event_type", "episode", F.col("begin_date").cast("string").alias("begin_date"), "magnitude", "scale", "damage")


@query("""
select distinct case when s_suppkey % 2 = 0 then 'IL' else 'IN' end || lpad(cast(s_suppkey % 200 as varchar), 3, '0') as zone_key, lpad(cast(s_nationkey as varchar), 5, '0') as fips from supplier where s_suppkey % 5 <> 0 and s_suppkey % 7 <> 0
""")
def zone_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14: crosswalk rows of the right lengths and of one state."""
    k = F.col("s_suppkey")
    state = F.when(k % 2 == 0, "IL").otherwise("IN")
    zone = F.concat(F.when(k % 7 == 0, "MI").otherwise(state), F.lpad((k % 200).cast("string"), 3, "0"))
    fips = F.lpad(F.col("s_nationkey").cast("string"), 5, "0")
    rows = table(spark, d, "supplier").select(F.concat(state, F.lit(" ")).alias("STATE"), zone.alias("STATE_ZONE"), F.when(k % 5 == 0, F.left(fips, F.lit(4))).otherwise(F.concat(F.lit(" "), fips)).alias("FIPS"))
    return readers.crosswalk(rows)


@query("""
select l_orderkey, lpad(cast(l_linenumber as varchar), 8, '0') as site, case when l_quantity <= 40 then l_quantity end as peak from lineitem
""")
def peak_listings(spark: SparkSession, d: str) -> DataFrame:
    """SRC-12: tab-separated listings with comments, a header and a row of formats, one document an order."""
    line = F.concat_ws("\t", F.lpad(F.col("l_linenumber").cast("string"), 8, "0"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("string")).otherwise(""))
    docs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return readers.rdb_documents(docs.select("l_orderkey", F.concat(F.lit("# peaks\n#\nsite_no\tpeak_va\n15s\t12n\n"), "body").alias("document")), "site string, peak double")


@query("""
select l_orderkey, cast((l_linenumber - 1) // 3 as int) as page, cast(l_linenumber as int) as line, l_quantity as quantity, l_linenumber <= 3 as more from lineitem
""")
def feature_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC-19: pages of a feature service, each telling whether there are more."""
    page = F.floor((F.col("l_linenumber") - 1) / 3).cast("int")
    feature = F.struct(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity")).alias("attributes"))
    docs = table(spark, d, "lineitem").groupBy("l_orderkey", page.alias("page")).agg(F.collect_list(feature).alias("features"))
    text = F.to_json(F.struct("features", F.when(F.col("page") == 0, True).alias("exceededTransferLimit")))
    return readers.features(docs.select("l_orderkey", "page", text.alias("document")), "line int, quantity double").select("l_orderkey", "page", "line", "quantity", "more")


@query("""
with b as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, 'brief-' || o_orderkey || '.pdf' as link from orders)
select o_custkey, day, link from (select *, row_number() over (partition by o_custkey order by day desc, link desc) as r from b) where r = 1
""")
def latest_briefs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-23: links with their ending, the latest of each series."""
    raw = F.concat(F.lit("brief-"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".pdf").otherwise(""))
    rows = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), readers.document_link(raw).alias("link"))
    return rows.groupBy("o_custkey").agg(F.max(F.struct("day", "link")).alias("b")).select("o_custkey", "b.*")


@query("""
select p_partkey, p_size from part where p_partkey % 5 <> 0 and p_partkey <> 1
""")
def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """FLT-19, SRC-26: a listing of files with sizes, without hidden ones and the lists themselves."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("_"), k.cast("string"))).when(k == 1, "manifest").otherwise(k.cast("string"))
    rows = table(spark, d, "part").withColumn("path", F.concat(F.lit("data/_x/"), name, F.lit(".json")))
    return rows.where(readers.listed(F.col("path"), ["manifest.json", "lineage.json"])).select("p_partkey", "p_size")


@query("""
with p as (select l_orderkey, l_linenumber, floor(l_quantity / 25) as x, l_tax as y, lag(floor(l_quantity / 25)) over w as px, lag(l_tax) over w as py from lineitem window w as (partition by l_orderkey order by l_linenumber, floor(l_quantity / 25), l_tax)),
k as (select * from p where px is null or x <> px or y <> py)
select l_orderkey, count(*) as points, round(sum(x) / count(*), 5) as mean_x, round(sum(y) / count(*), 5) as mean_y from k group by 1 having count(*) >= 4
""")
def ring_centroids(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18, WIN-11, AGG-24: rings of polygons without repeated points, those of four points or more, and the mean of their vertices."""
    point = F.struct("l_linenumber", F.floor(F.col("l_quantity") / 25).cast("double").alias("x"), F.col("l_tax").alias("y"))
    drawn = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(point)), lambda p: F.array(p["x"], p["y"])).alias("ring"))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array("ring")).alias("coordinates")))
    rings = readers.polygon_rings(drawn.select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, one).otherwise(many).alias("document")))
    kept = rings.withColumn("points", geometry.simplified(F.col("points"))).where("points is not null")
    return kept.withColumn("c", geometry.centroid(F.col("points"))).select("l_orderkey", F.size("points").cast("long").alias("points"), F.col("c.x").alias("mean_x"), F.col("c.y").alias("mean_y"))


@query("""
with s as (select o_orderkey, cast(o_orderdate as date) as day, cast(o_orderdate as date) + cast(o_orderkey % 900 as int) as seen from orders),
c as (select o_orderkey, day, seen, case when o_orderkey % 3 = 0 then [day] else list_transform([0, 1, 2], lambda k: try_cast(concat_ws('-', extract(year from seen) - k, lpad(cast(extract(month from day) as varchar), 2, '0'), lpad(cast(extract(day from day) as varchar), 2, '0')) as date)) end as days from s)
select o_orderkey, strftime(case when o_orderkey % 3 = 0 then days[1] else list_max(list_filter(days, lambda x: x is not null and x <= seen)) end, '%Y-%m-%d') as dated from c
""")
def printed_dates(spark: SparkSession, d: str) -> DataFrame:
    """UDF-02: printed days with or without a year, the latest year that is not after the document's date."""
    day = _day("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "MMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "MMMM d")).otherwise(F.date_format(day, "MMM dd"))
    seen = F.date_add(day, (F.col("o_orderkey") % 900).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", parsing.printed_date(text, seen).cast("string").alias("dated"))


@query("""
with x as (select case when s_suppkey % 10 = 0 then 'k0' else 'k' || s_nationkey end as key, s_name as name, cast(s_acctbal as decimal(18,2)) as a from supplier),
p as (select key, name, sum(a) as a, count(*) as n from x group by 1, 2),
r as (select *, row_number() over (partition by key order by length(regexp_replace(name, '[^a-z]', '', 'g')) desc, a desc, length(name), name) as r from p)
select key, count(*) as variants, cast(sum(n) as bigint) as n, cast(sum(a) as double) as amount, max(name) filter (r = 1) as display from r group by 1
""")
def forced_merges(spark: SparkSession, d: str) -> DataFrame:
    """UDAF-03, AGG-34: names a curated table moves to another group, then groups with their best name."""
    s = table(spark, d, "supplier")
    forced = s.where("s_suppkey % 10 = 0").select(F.col("s_name").alias("name"), F.lit("k0").alias("target"))
    rows = s.select(F.concat(F.lit("k"), F.col("s_nationkey").cast("string")).alias("key"), F.col("s_name").alias("name"), "s_acctbal")
    return linkage.merged(rows, "key", "name", "s_acctbal", forced)
