"""Queries of rules: parsing, classes, gates, joins with fallbacks, readers of nested documents, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import classify, names, parsing
from gaugeworks.operators import aggregates, joins
from gaugeworks.operators.ranges import running
from gaugeworks.plans import panel
from gaugeworks.sources import readers
from gaugeworks.sources.readers import table

from .catalog import _day, query

_K = "cast(json_extract_string(props, '$.k') as bigint)"


@query(f"""
select event_id, coalesce(nullif({_K} % 4, 0), nullif(cast(floor(value) as bigint) % 3, 0), 0) as falsy, case when {_K} % 3 = 0 then 0.0 else cast({_K} as double) end as parsed, greatest(value - 40, 0) as clamped from events
""")
def falsy_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-02, PRJ-03: zero falls through, unreadable text is 0, negatives are 0."""
    k = F.from_json("props", "k long")["k"]
    text = F.when(k % 3 == 0, "n/a").otherwise(k.cast("string"))
    return table(spark, d, "events").select("event_id", parsing.falsy_to(k % 4, F.floor("value") % 3).alias("falsy"), parsing.number(text).alias("parsed"), F.greatest(F.col("value") - 40, F.lit(0.0)).alias("clamped"))


@query("""
select s_suppkey, case s_suppkey % 5 when 0 then 1 when 1 then 3 when 2 then null when 3 then null else 5 end as loose, case s_suppkey % 5 when 1 then 3 when 4 then 5 end as strict from supplier
""")
def tornado_scales(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-05: both readings of a tornado scale."""
    k = F.col("s_suppkey") % 5
    text = F.when(k == 0, "F1").when(k == 1, "EF3").when(k == 2, "EFU").when(k == 4, "ef5")
    return table(spark, d, "supplier").select("s_suppkey", parsing.tornado_scale(text).alias("loose"), parsing.tornado_scale(text, enhanced_only=True).alias("strict"))


@query("""
select l_orderkey, l_linenumber, cast(round_even(l_quantity * 1.151, 0) as int) as mph, round_even(l_quantity * 0.3, 2) as water, l_quantity between 5 and 45 as plausible from lineitem
""")
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-06, FLT-03: knots to miles, depth to water, and the guard against sentinels."""
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(q * panel.MPH).cast("int").alias("mph"), F.bround(q * panel.SNOW_WATER, 2).alias("water"), q.between(5, 45).alias("plausible"))


@query("""
select p_partkey, case when p_type like '%PROMO%' then 'flood' when p_size >= 40 then 'tornado' when p_type like 'SMALL%' then 'wind' when p_name like '%hot%' then 'heat' else 'other' end as family,
(p_size > 25 or p_retailprice > 1500) as declared, case p_brand[7:7] when '1' then 'IL' when '2' then 'IN' when '3' then 'MI' else '??' end as state from part
""")
def hazard_families(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-08, PRJ-12, PRJ-16, FLT-11: a class by priority, a flag by OR, a code by a constant map."""
    rules = [(F.col("p_type").contains("PROMO"), "flood"), (F.col("p_size") >= 40, "tornado"), (F.col("p_type").startswith("SMALL"), "wind"), (F.col("p_name").contains("hot"), "heat")]
    codes = F.create_map(*map(F.lit, ("1", "IL", "2", "IN", "3", "MI")))
    code = F.coalesce(F.try_element_at(codes, F.substring("p_brand", 7, 1)), F.lit("??"))
    return table(spark, d, "part").select("p_partkey", classify.first_matching(rules, "other").alias("family"), ((F.col("p_size") > 25) | (F.col("p_retailprice") > 1500)).alias("declared"), code.alias("state"))


@query("""
select o_orderkey, array_to_string(list_filter([case when o_orderstatus = 'F' then 'closed' end, case when o_totalprice > 300000 then 'large' end, case when o_custkey % 3 <> 0 then 'third' end], lambda x: x is not null), ',') as kept from orders
""")
def sparse_maps(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-13, FN-16: a struct without its null and zero fields."""
    m = F.create_map(F.lit("closed"), F.when(F.col("o_orderstatus") == "F", 1), F.lit("large"), (F.col("o_totalprice") > 300000).cast("int"), F.lit("third"), (F.col("o_custkey") % 3).cast("int"))
    kept = F.map_filter(m, lambda _, v: v.isNotNull() & (v != 0))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.map_keys(kept), ",").alias("kept"))


@query("""
select s_suppkey, case when s_suppkey % 7 = 0 then null else lpad(cast(s_nationkey as varchar), 2, '0') || case when s_suppkey % 7 >= 1000 then cast(s_suppkey % 7 as varchar) else lpad(cast(s_suppkey % 7 as varchar), 3, '0') end end as fips from supplier
""")
def county_codes(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-14, SRC-16: five-digit codes, null for the whole state."""
    return table(spark, d, "supplier").select("s_suppkey", parsing.county_code(F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 7).cast("string")).alias("fips"))


@query("""
with n as (select l_suppkey, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'R') as r, count(*) filter (l_quantity > 48) as w from lineitem group by 1)
select l_suppkey, case when a = greatest(a, r, w) and a > 0 then 'Flood' when r = greatest(a, r, w) and r > 0 then 'Tornado' when w = greatest(a, r, w) and w > 0 then 'Winter' else 'Severe Storm' end as incident from n
""")
def dominant_incident(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-17: the class of most rows, ties by a fixed order."""
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_quantity") > 48).alias("w"))
    top = F.greatest("a", "r", "w")
    return n.select("l_suppkey", classify.first_matching([((F.col(c) == top) & (F.col(c) > 0), v) for c, v in (("a", "Flood"), ("r", "Tornado"), ("w", "Winter"))], "Severe Storm").alias("incident"))


@query("""
select p_partkey, case when left(p_type, 1) in ('S', 'M') then 'in' when left(p_type, 1) in ('L', 'P') then 'out' else 'unk' end as zone,
case when p_name like '%gear%' then 'fire' when p_name like '%old%' then 'prep' when p_name like '%bolt%' or p_name like '%gizmo%' then 'port' end as program,
case when p_brand = 'Brand#1' then 'covid' when p_size < 20 then 'em' else 'dr' end as class from part
""")
def zone_program_and_class(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-20, PRJ-21, PRJ-23: classes by first letter, by keyword priority, and exclusive ones."""
    low, first = F.lower("p_name"), F.left("p_type", F.lit(1))
    zone = classify.first_matching([(first.isin("S", "M"), "in"), (first.isin("L", "P"), "out")], "unk")
    program = classify.first_matching([(low.contains("gear"), "fire"), (low.contains("old"), "prep"), (low.contains("bolt") | low.contains("gizmo"), "port")], None)
    kind = classify.first_matching([(F.col("p_brand") == "Brand#1", "covid"), (F.col("p_size") < 20, "em")], "dr")
    return table(spark, d, "part").select("p_partkey", zone.alias("zone"), program.alias("program"), kind.alias("class"))


@query("""
select o_orderkey, round(cast(date '2002-01-01' - cast(o_orderdate as date) as bigint) / 365.25, 4) as age, cast(date '2002-01-01' - cast(o_orderdate as date) as bigint) / 365.25 >= 2 as mature,
'orders' as source, substring(o_orderpriority, 1, 4) as title, cast(row_number() over (partition by o_custkey order by coalesce(case when o_orderstatus <> 'O' then o_orderstatus end, ''), o_orderkey) as int) as place from orders
""")
def ages_and_titles(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-26, PRJ-27, PRJ-28, SRT-06, SRT-07: age at a stated date, literals, cut titles, order with nulls as blank and a tie-break."""
    age = F.datediff(F.lit("2002-01-01").cast("date"), _day("o_orderdate")) / 365.25
    status = F.coalesce(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.lit(""))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(status, "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.round(age, 4).alias("age"), (age >= 2).alias("mature"), F.lit("orders").alias("source"), F.substring("o_orderpriority", 1, 4).alias("title"), place.alias("place"))


@query("""
select l_orderkey, l_linenumber from lineitem join orders on o_orderkey = l_orderkey where l_returnflag in ('A', 'R') and cast(l_shipdate as date) between cast(o_orderdate as date) - 1 and cast(o_orderdate as date) + 14 and (l_quantity >= 45 or l_discount >= 0.09 or l_tax = 0)
""")
def padded_candidates(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01, FLT-04, FLT-20: membership, a padded window and inclusion by any of several measures."""
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & ((F.col("l_quantity") >= 45) | (F.col("l_discount") >= 0.09) | (F.col("l_tax") == 0)))
    joined = rows.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    begin = _day("o_orderdate")
    return joined.where(_day("l_shipdate").between(F.date_sub(begin, 1), F.date_add(begin, 14))).select("l_orderkey", "l_linenumber")


@query("""
with x as (select o_orderstatus, o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') as pandemic, extract(year from o_orderdate) < 1996 as early from orders)
select o_orderstatus, count(*) as n, count(*) filter (pandemic) as excluded, count(*) filter (not pandemic and early) as dropped, count(*) filter (not pandemic and not early) as kept from x group by 1
""")
def excluded_and_dropped(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05, FLT-06: rows excluded by a set of numbers, then a year floor, both counted."""
    flagged = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("p"))
    rows = table(spark, d, "orders").join(flagged, "o_custkey", "left")
    out, early = F.coalesce("p", F.lit(False)), F.year("o_orderdate") < 1996
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(out).alias("excluded"), F.count_if(~out & early).alias("dropped"), F.count_if(~out & ~early).alias("kept"))


@query("""
select l_orderkey, l_linenumber, case when extract(month from l_shipdate) in (12, 1, 2, 3, 4) then l_quantity else 0.0 end as depth, (l_returnflag = 'A' or l_linenumber >= 6 or l_quantity >= 48 or l_discount >= 0.1) as over from lineitem
""")
def seasonal_and_over(spark: SparkSession, d: str) -> DataFrame:
    """FLT-08, FLT-13: 0 outside the season, and the over-threshold flag."""
    depth = F.when(F.month("l_shipdate").isin(*panel.COLD_MONTHS), F.col("l_quantity")).otherwise(F.lit(0.0))
    over = (F.col("l_returnflag") == "A") | (F.col("l_linenumber") >= 6) | (F.col("l_quantity") >= 48) | (F.col("l_discount") >= 0.1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", depth.alias("depth"), over.alias("over"))


@query("""
with m as (select 'quantity' as metric, l_quantity as v, l_returnflag = 'R' as y from lineitem union all select 'discount', l_discount, l_returnflag = 'R' from lineitem union all select 'tax', l_tax, l_returnflag = 'R' from lineitem union all select 'none', 0.0, l_returnflag = 'R' from lineitem),
g as (select metric from m group by 1 having count(distinct v) > 1 and count(*) filter (v <> 0) >= greatest(50, 0.01 * count(*))),
r as (select metric, y, rank() over (partition by metric order by v) + (count(*) over (partition by metric, v) - 1) / 2.0 as r from m where metric in (select metric from g)),
a as (select metric, count(*) filter (y) as positives, count(*) filter (not y) as negatives, (sum(r) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2.0) / (count(*) filter (y) * cast(count(*) filter (not y) as double)) as auc from r group by 1)
select metric, positives, negatives, round(auc, 4) as auc, cast(rank() over (order by round(auc, 4) desc) as int) as place from a
""")
def separation_study(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10, WIN-09, UDAF-01: metrics that vary enough, by how well they separate, best first."""
    rows = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    long = rows.select("y", F.expr("stack(4, 'quantity', l_quantity, 'discount', l_discount, 'tax', l_tax, 'none', 0.0D) as (metric, v)"))
    gate = long.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("v") != 0).alias("some"), F.count("*").alias("n")).where("lo < hi and some >= greatest(50, 0.01 * n)")
    # values are counted before anything is joined, so no metric's rows are dealt to one task
    auc = aggregates.rank_auc(long, "v", "y", ["metric"]).join(gate.select("metric"), "metric", "left_semi").withColumn("auc", F.round("auc", 4))
    return auc.withColumn("place", F.rank().over(Window.orderBy(F.desc("auc"))))  # one row a metric


@query("""
with t as (select o_orderkey, o_orderstatus = 'F' as declared, list_distinct(list(l_returnflag)) as tags from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)
select o_orderkey, declared and len(list_intersect(tags, ['R', 'X'])) > 0 as attributed from t where not list_contains(tags, 'N') or declared
""")
def exact_attribution(spark: SparkSession, d: str) -> DataFrame:
    """FLT-12, FLT-14: declared and of the hazard's tags; the gate holds for one class only."""
    tags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("tags"))
    rows = table(spark, d, "orders").join(tags, F.col("o_orderkey") == F.col("l_orderkey"))
    declared = F.col("o_orderstatus") == "F"
    return rows.where(~F.array_contains("tags", "N") | declared).select("o_orderkey", (declared & F.arrays_overlap("tags", F.array(F.lit("R"), F.lit("X")))).alias("attributed"))


@query("""
select doc_id, (contains(lower(text), 'license') or contains(lower(text), 'idiot')) and not contains(lower(text), 'mit license') as banned, regexp_matches(text, '(?i)["''.\\[ ]license\\b') as grounded from documents
""")
def banned_phrases(spark: SparkSession, d: str) -> DataFrame:
    """FLT-18: banned phrases with an allowed one, and a word that stands as a word."""
    low = F.lower("text")
    banned = (low.contains("license") | low.contains("idiot")) & ~low.contains("mit license")
    return table(spark, d, "documents").select("doc_id", banned.alias("banned"), F.col("text").rlike(r"""(?i)["'.\[ ]license\b""").alias("grounded"))


@query("""
with u as (select p_partkey, p_partkey % 6 as k, p_name || ' (' || p_brand || ')' as col from part)
select p_partkey, col as "column", k in (0, 1, 2) as grounded from u
""")
def grounded_columns(spark: SparkSession, d: str) -> DataFrame:
    """FN-20: whether a script names a dictionary's column after a quote, a dot or a bracket, as a whole word."""
    k, name = F.col("p_partkey") % 6, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    script = (
        F.when(k == 0, F.concat(F.lit("row.get('"), name, F.lit("')")))
        .when(k == 1, F.concat(F.lit('df["'), F.upper(name), F.lit('"] ; df.'), name, F.lit("s")))
        .when(k == 2, F.concat(F.lit("x["), name, F.lit("]")))
        .when(k == 3, F.concat(F.lit("# the "), name, F.lit(" of each row")))
        .when(k == 4, F.concat(F.lit("row['"), name, F.lit("_total']")))
        .otherwise(F.concat(F.lit("row['"), F.replace(name, F.lit("("), F.lit("[")), F.lit("']")))
    )
    return table(spark, d, "part").select("p_partkey", name.alias("column"), parsing.grounded(script, name).alias("grounded"))


@query("""
select c_custkey, s.n as population, coalesce(s.h, c_acctbal) as housing, cast(null as double) as optional from customer left join (select s_nationkey, count(*) as n, max(case when s_acctbal > 9000 then s_acctbal end) as h from supplier group by 1) s on s_nationkey = c_nationkey
""")
def optional_exposure(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-01, JOIN-25, SRC-30: a left join that replaces a value where there is one, and an absent input as null columns."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("population"), F.max(F.when(F.col("s_acctbal") > 9000, F.col("s_acctbal"))).alias("h"))
    absent = spark.createDataFrame([], "c_custkey long, optional double")
    rows = table(spark, d, "customer").join(s, "c_nationkey", "left").join(absent, "c_custkey", "left")
    return rows.select("c_custkey", "population", F.coalesce("h", "c_acctbal").alias("housing"), "optional")


@query("""
with k as (select s_suppkey, s_nationkey, replace(replace(lower(s_name), '#', ''), 'supplier', 'st') as base from supplier)
select a.s_suppkey, case when a.s_suppkey % 10 = 0 then null else a.s_suppkey end as matched from k a
""")
def normalized_county_join(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-08: names of two spellings meet by state and normalized key; misses stay."""
    s = table(spark, d, "supplier").withColumn("base", F.regexp_replace(F.lower("s_name"), "supplier#", "St. "))
    left = s.select("s_suppkey", "s_nationkey", names.county_key(F.concat("base", F.lit(" County"))).alias("key"))
    right = s.where("s_suppkey % 10 <> 0").select("s_nationkey", names.county_key(F.translate("base", ".", "")).alias("key"), F.col("s_suppkey").alias("matched"))
    return left.join(right, ["s_nationkey", "key"], "left").select("s_suppkey", "matched")


@query("""
with x as (select s_nationkey, 'balance' as parameter, cast(least(floor(greatest(s_acctbal, 0) / 2500), 3) as int) as bin from supplier union all select s_nationkey, 'key', cast(s_suppkey % 4 as int) from supplier)
select s_nationkey, parameter, bin, count(*) as n from x group by all
""")
def cells_by_parameter(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-18: every state and parameter by bins, unpivoted instead of crossed."""
    s = table(spark, d, "supplier").select("s_nationkey", F.least(F.floor(F.greatest("s_acctbal", F.lit(0.0)) / 2500), F.lit(3)).cast("int").alias("b"), (F.col("s_suppkey") % 4).cast("int").alias("k"))
    return s.select("s_nationkey", F.expr("stack(2, 'balance', b, 'key', k) as (parameter, bin)")).groupBy("s_nationkey", "parameter", "bin").agg(F.count("*").alias("n"))


@query("""
with f as (select *, row_number() over (partition by user_id, cast(ts as date) order by event_id) as r from events)
select o_orderkey, event_id as first_event from orders left join f on user_id = o_custkey and cast(ts as date) - 8766 = cast(o_orderdate as date) and r = 1
""")
def first_detail(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-22, WIN-03: the first detail row of a key and raw date, merged onto each row; events are dated 24 years back, onto the orders."""
    e = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"), F.date_sub(_day("ts"), 8766).alias("day"), F.col("event_id").alias("first_event"))
    first = joins.keep_first(e, ["o_custkey", "day"], "first_event")
    return table(spark, d, "orders").withColumn("day", _day("o_orderdate")).join(first, ["o_custkey", "day"], "left").select("o_orderkey", "first_event")


@query("""
with t as (select p_partkey, case p_partkey % 4 when 0 then string_split(p_name, ' ') when 1 then list_concat(string_split(p_name, ' '), string_split(p_name, ' ')[-1:]) when 2 then list_concat(string_split(p_name, ' '), string_split(p_name, ' ')) else ['a', 'b', 'c', 'a', 'b', 'c'] end as t from part),
a as (select p_partkey, case when len(t) >= 6 and t[len(t) - 5:len(t) - 3] = t[len(t) - 2:] then t[:len(t) - 3] else t end as t from t),
b as (select p_partkey, case when len(t) >= 4 and t[len(t) - 3:len(t) - 2] = t[len(t) - 1:] then t[:len(t) - 2] else t end as t from a)
select p_partkey, array_to_string(case when len(t) >= 2 and t[len(t) - 1] = t[len(t)] then t[:len(t) - 1] else t end, ' ') as name from b
""")
def repeated_endings(spark: SparkSession, d: str) -> DataFrame:
    """WIN-12: an ending of three, two or one words that repeats the words before it goes."""
    w, k = F.split("p_name", " "), F.col("p_partkey") % 4
    tokens = F.when(k == 0, w).when(k == 1, F.concat(w, F.slice(w, -1, 1))).when(k == 2, F.concat(w, w)).otherwise(F.array(*map(F.lit, "abcabc")))
    return table(spark, d, "part").select("p_partkey", F.array_join(names.without_repeated_ending(tokens), " ").alias("name"))


@query("""
with w as (select p_partkey, list_filter(regexp_extract_all(lower(p_type || ' of the rings'), '[a-z]+'), lambda x: x not in ('the', 'of', 'and', 'for', 'in', 'a', 'an')) as w from part)
select p_partkey, array_to_string(list_sort(list_distinct(list_transform(w, lambda x: case when length(x) > 3 then regexp_replace(x, 's$', '') else x end))), ' ') as stems from w
""")
def stemmed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """FN-07: words without stop words and plural endings."""
    return table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(names.stems(F.concat("p_type", F.lit(" of the rings")))), " ").alias("stems"))


@query("""
with t as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then 'in ' || strftime(o_orderdate, '%Y') || ' or so' when 2 then strftime(o_orderdate, '%Y') else 'n/a' end as t, extract(year from o_orderdate) as y from orders)
select o_orderkey, case when o_orderkey % 4 in (0, 2) then y end as prefix, case when o_orderkey % 4 <> 3 then y end as anywhere, case when o_orderkey % 4 = 2 then y end as number,
cast(cast(make_timestamp((o_orderkey * 86400000000)::bigint % 1000000000000000) as date) as varchar) as day, case when o_orderkey % 24 = 0 then '12:05 AM' when o_orderkey % 24 < 12 then (o_orderkey % 24) || ':05 AM' when o_orderkey % 24 = 12 then '12:05 PM' else (o_orderkey % 24 - 12) || ':05 PM' end as clock from t
""")
def year_and_clock_rules(spark: SparkSession, d: str) -> DataFrame:
    """FN-12, FN-13: three readings of a year, epoch milliseconds and clock labels."""
    k, text = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    t = F.when(k == 0, text).when(k == 1, F.concat(F.lit("in "), F.left(text, F.lit(4)), F.lit(" or so"))).when(k == 2, F.left(text, F.lit(4))).otherwise("n/a")
    clock = parsing.clock_label(F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":05")))
    return table(spark, d, "orders").select("o_orderkey", parsing.year_prefix(t).cast("long").alias("prefix"), parsing.year_anywhere(t).cast("long").alias("anywhere"), parsing.year_number(t).cast("long").alias("number"), parsing.epoch_date(F.col("o_orderkey") * 86_400_000 % 1_000_000_000_000).cast("string").alias("day"), clock.alias("clock"))


@query("""
select o_orderkey, '$' || format('{:,}', cast(floor(o_totalprice) as bigint)) as money, cast(cast(floor(o_totalprice / 10000) as bigint) as varchar) || '%' as percent from orders
""")
def display_text(spark: SparkSession, d: str) -> DataFrame:
    """FN-18: money with separators and percent text."""
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0)).alias("money"), F.concat(F.floor(F.col("o_totalprice") / 10000).cast("string"), F.lit("%")).alias("percent"))


@query("""
with s as (select chr(65 + n_nationkey // 5) || chr(65 + n_nationkey % 5) as code, r_name as region, n_nationkey from nation join region on r_regionkey = n_regionkey),
e as (select s_suppkey, s_suppkey % 6 as k, code, region from supplier join s on n_nationkey = s_nationkey)
select s_suppkey, case when k < 2 then 'state' else 'tribal' end as kind, case when k < 2 then code when k = 5 then 'ZZ' else 'Nation' end as code, case k when 2 then 'Upper River Band ' || code when 3 then 'Band of the Lake, ' || code when 4 then 'Lost Band' end as name,
case k when 0 then code when 1 then code when 2 then 'BC' when 3 then code end as state, case k when 2 then (select region from s where code = 'BC') when 4 then null when 5 then null else region end as region from e
""")
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """FN-19, UDF-03: entities as lists print them: codes with a footnote's number, nations named by footnotes, placed by a part of the name or its end."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.concat(*(F.expr(f"char(65 + {x})") for x in ("n_nationkey div 5", "n_nationkey % 5")))
    states = n.select("n_nationkey", code.alias("code"), "r_name")
    every = states.agg(F.map_from_entries(F.collect_list(F.struct("code", "r_name"))).alias("states"))  # one row, an entry a state
    rows = table(spark, d, "supplier").join(states, F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(every))
    k, mark = F.col("s_suppkey") % 6, F.col("s_suppkey").cast("string")
    raw = F.when(k == 0, F.concat("code", mark)).when(k == 1, F.concat(F.lit("  "), F.lower("code"), F.lit(" "))).when(k == 5, "ZZ").otherwise(F.concat(F.lit("Nation "), mark))
    note = F.when(k == 2, F.concat(F.lit("Upper River Band "), "code")).when(k == 3, F.concat(F.lit("Band of the Lake, "), "code")).otherwise("Lost Band")
    tribes = F.create_map(*map(F.lit, ("river band", "BC", "lost band of", "AA")))
    found = names.resolved_entity(raw, F.create_map(mark, note), F.col("states"), tribes)
    return rows.select("s_suppkey", found.alias("e")).select("s_suppkey", "e.*")


@query("""
select cast(user_id as varchar) as fips, cast(cast(ts as date) as varchar) as day, round(avg(value), 6) as mean, max(value) as most from events group by 1, 2
""")
def gridded_daily(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09, AGG-36: daily documents of county means and peaks, flattened."""
    per = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("u"), _day("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    docs = per.groupBy("day").agg(*(F.to_json(F.map_from_entries(F.collect_list(F.struct("u", c)))).alias(c) for c in ("mean", "most")))
    text = F.concat(F.lit('[["'), F.col("day").cast("string"), F.lit('",'), F.col("mean"), F.lit(","), F.col("most"), F.lit("]]"))
    return readers.gridded_days(docs.select(text.alias("document"))).withColumn("day", F.col("day").cast("string"))


@query("""
select cast(user_id as varchar) as site, cast(cast(ts as date) as varchar) as day, value from events where value <= 75
""")
def gauge_documents(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10, FLT-03: nested series documents, one for each site, flattened and guarded."""
    points = F.collect_list(F.struct(F.col("value").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime")))
    docs = table(spark, d, "events").groupBy("user_id").agg(points.alias("p"))
    series = F.struct(F.struct(F.array(F.struct(F.col("user_id").cast("string").alias("value"))).alias("siteCode")).alias("sourceInfo"), F.array(F.struct(F.col("p").alias("value"))).alias("values"))
    text = F.to_json(F.struct(F.struct(F.array(series).alias("timeSeries")).alias("value")))
    return readers.gauge_series(docs.select(text.alias("document"))).withColumn("day", F.col("day").cast("string"))


@query("""
with x as (select o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as k, o_orderkey from orders)
select lpad(cast(o_custkey as varchar), 9, '0') as fips, 0 as station, cast(date '2020-01-01' + cast(k as int) as varchar) as day, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 0.0 else cast(o_orderkey % 100 as double) end as value from x
""")
def station_arrays(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08, UDTF-01: arrays of daily values dated from their start; M is missing, T a trace."""
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "M").when(k % 5 == 1, "T").otherwise(F.concat((k % 100).cast("string"), F.when(k % 2 == 0, "A").otherwise("")))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", text.alias("t")))), lambda x: x["t"]).alias("v"))
    rows = lists.select(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("fips"), F.lit("2020-01-01").alias("sdate"), F.array("v").alias("stations"))
    return readers.station_days(rows).withColumn("day", F.col("day").cast("string"))


@query("""
select cast(n_nationkey as varchar) as value, 'state' as column, count(*) as n from nation group by 1 union all select cast(n_regionkey as varchar), 'region', count(*) from nation group by 1
""")
def header_arrays(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15: arrays whose first row names the columns."""
    row = F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))
    docs = table(spark, d, "nation").select(F.to_json(F.array(F.array(*map(F.lit, ("NAME", "state", "region"))), row)).alias("document"))
    return readers.header_array(docs.select("document")).where("column <> 'NAME'").groupBy("column", "value").agg(F.count("*").alias("n"))


@query("""
select o_orderkey, coalesce(i.v, d.v) as level, case when i.v is not null then 'instant' when d.v is not null then 'daily' end as kind from orders
left join (select user_id, cast(ts as date) - 8766 as day, max(value) as v from events where event_type = 'view' group by 1, 2) i on i.user_id = o_custkey and i.day = cast(o_orderdate as date)
left join (select user_id, max(value) as v from events group by 1) d on d.user_id = o_custkey
""")
def instant_else_daily(spark: SparkSession, d: str) -> DataFrame:
    """SRC-11: the finer source first, the coarser one for what it lacks; readings are dated 24 years back, onto the orders."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "o_custkey")
    fine = e.where("event_type = 'view'").groupBy("o_custkey", F.date_sub(_day("ts"), 8766).alias("day")).agg(F.max("value").alias("i"))
    coarse = e.groupBy("o_custkey").agg(F.max("value").alias("d"))
    rows = table(spark, d, "orders").withColumn("day", _day("o_orderdate")).join(fine, ["o_custkey", "day"], "left").join(coarse, "o_custkey", "left")
    return rows.select("o_orderkey", F.coalesce("i", "d").alias("level"), classify.first_matching([(F.col("i").isNotNull(), "instant"), (F.col("d").isNotNull(), "daily")], None).alias("kind"))


@query("""
select cast(floor((r - 1) / 45) as int) as request, count(*) as keys, count(*) filter (o.k is not null) as found from (select c_custkey, row_number() over (order by c_custkey) as r from customer where c_acctbal > 0) c left join (select distinct o_custkey as k from orders) o on k = c_custkey group by 1
""")
def in_list_requests(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06: keys in lists of 45, as a service takes them, and how many of each were found."""
    keys = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    numbered = running(keys.groupBy("c_custkey").agg(F.count("*").alias("one")), (), "c_custkey", ["one"])
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("h", F.lit(1))
    return numbered.join(have, "c_custkey", "left").groupBy(F.floor((F.col("one_upto") - 1) / 45).cast("int").alias("request")).agg(F.count("*").alias("keys"), F.count("h").alias("found"))


@query("""
select 'p_' || substr(p_brand, 7) as name, count(*) as n from part group by 1
""")
def dictionary_names(spark: SparkSession, d: str) -> DataFrame:
    """SRC-24, SRC-28: every name of a nested field dictionary, read from JSON."""
    field = F.struct(F.concat(F.lit("p_"), F.substring("p_brand", 7, 9)).alias("name"), F.lit("string").alias("type"))
    docs = table(spark, d, "part").groupBy("p_size").agg(F.to_json(F.struct(F.lit("x").alias("dataset"), F.array(F.struct(F.collect_list(field).alias("columns"))).alias("fields"))).alias("document"))
    return readers.field_names(docs).groupBy("name").agg(F.count("*").alias("n"))


@query("""
with c as (select s_suppkey, n_name, length(n_name) as n, row_number() over (partition by s_suppkey order by length(n_name) desc, n_name) as r from supplier join nation on contains(case s_suppkey % 3 when 0 then 'upper ' || 'NATION_' || s_nationkey else 'x' || n_name || 'y' end, n_name) where n_nationkey = s_nationkey)
select s_suppkey, n_name as candidate from c where r <= 5
""")
def contained_candidates(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13: candidates whose name stands within a listing's, five at most, longest first; the key verifies them."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    listing = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("upper NATION_"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("x"), "n_name", F.lit("y")))
    found = s.where(F.contains(listing, F.col("n_name")))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("s_suppkey").orderBy(F.desc(F.length("n_name")), "n_name")))
    return ranked.where("r <= 5").select("s_suppkey", F.col("n_name").alias("candidate"))


@query("""
with e as (select *, case l_returnflag when 'A' then 'Hail' when 'R' then 'Tornado' else case when l_linestatus = 'F' then 'Flash Flood' when l_linenumber % 2 = 0 then 'High Wind' else 'Blizzard' end end as kind from lineitem)
select lpad(cast(l_suppkey % 1000 as varchar), 5, '0') as fips, cast(l_suppkey % 7 as varchar) as state, l_orderkey as episode, cast(min(cast(l_shipdate as date)) as varchar) as begin, cast(max(cast(l_shipdate as date)) as varchar) as "end", array_to_string(list_sort(list_distinct(list(kind))), '|') as types,
cast(round_even(coalesce(max(case when kind = 'High Wind' and l_quantity <> 0 and not l_discount > 0.05 then l_quantity * 1.151 end), 0), 0) as int) as gust,
cast(round_even(coalesce(max(case when kind = 'High Wind' and l_quantity <> 0 and l_discount > 0.05 then l_quantity * 1.151 end), 0), 0) as int) as sustained,
coalesce(max(case when kind = 'Hail' then l_quantity end), 0.0) as hail, count(*) filter (kind = 'Tornado') as tornadoes, coalesce(max(case when kind = 'Tornado' then cast(l_linenumber % 6 as int) end), -1) as ef,
bool_or(kind = 'Flash Flood') as flood, bool_or(kind = 'Blizzard') as winter, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as damage from e group by 1, 2, 3
""")
def county_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The county panel: one row for each county and episode, all measures in one aggregation."""
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    kind = F.when(flag == "A", "Hail").when(flag == "R", "Tornado").when(F.col("l_linestatus") == "F", "Flash Flood").when(n % 2 == 0, "High Wind").otherwise("Blizzard")
    storms = table(spark, d, "lineitem").select(
        F.lpad((F.col("l_suppkey") % 1000).cast("string"), 5, "0").alias("fips"), (F.col("l_suppkey") % 7).cast("string").alias("state"), F.col("l_orderkey").alias("episode"), kind.alias("event_type"), F.col("l_quantity").alias("magnitude"),
        F.when(F.col("l_discount") > 0.05, "MS").otherwise("EG").alias("magnitude_type"), (n % 6).cast("int").alias("scale"), F.floor("l_extendedprice").cast("double").alias("damage"), _day("l_shipdate").alias("begin_date"), F.lit(False).alias("zoned"),
    )
    out = panel.episodes(storms)
    return out.select("fips", "state", "episode", F.col("begin").cast("string").alias("begin"), F.col("end").cast("string").alias("end"), F.array_join("types", "|").alias("types"), "gust", "sustained", "hail", "tornadoes", "ef", "flood", "winter", "damage")
