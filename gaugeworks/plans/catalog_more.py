"""Further queries: scalar functions, names, analogs, graphs, cubes, sessions, checks and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import classify, names, parsing
from gaugeworks.operators import aggregates, buckets, graph, joins, learning, linkage, similarity, windows
from gaugeworks.sources.readers import fresh_keys, table

from .catalog import _day, query


@query("""
select p_partkey, lower(p_name) as low, case when length(p_brand) < 12 then lpad(p_brand, 12, '0') else p_brand end as padded, substring(p_type, 1, 5) as head, split_part(p_type, ' ', 2) as second,
regexp_extract(p_brand, '([0-9]+)', 1) as digits, length(regexp_replace(p_name, '[^a-z]', '', 'g')) as letters, starts_with(p_type, 'S') as s, translate(p_name, 'ae', 'AE') as swapped from part
""")
def string_scalars(spark: SparkSession, d: str) -> DataFrame:
    """FN-01..FN-06: padding, case, parts, patterns."""
    c = F.col
    return table(spark, d, "part").select(
        "p_partkey", F.lower("p_name").alias("low"), parsing.pad_code(c("p_brand"), 12).alias("padded"), F.substring("p_type", 1, 5).alias("head"), F.coalesce(F.get(F.split("p_type", " "), F.lit(1)), F.lit("")).alias("second"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.length(F.regexp_replace("p_name", "[^a-z]", "")).cast("long").alias("letters"), c("p_type").startswith("S").alias("s"), F.translate("p_name", "ae", "AE").alias("swapped"),
    )


@query("""
select o_orderkey, cast(cast(o_orderdate as date) + 30 as varchar) as due, cast(date_trunc('month', o_orderdate)::date as varchar) as month, cast(date '2001-12-31' - cast(o_orderdate as date) as bigint) as age,
extract(month from o_orderdate) as m, case when extract(month from o_orderdate) in (12, 1, 2) then 'winter' when extract(month from o_orderdate) in (3, 4, 5) then 'spring' when extract(month from o_orderdate) in (6, 7, 8) then 'summer' else 'fall' end as season,
cast(last_day(cast(o_orderdate as date)) as varchar) as month_end from orders
""")
def date_scalars(spark: SparkSession, d: str) -> DataFrame:
    """FN-09, FN-11, PRJ-18: arithmetic and parts of dates."""
    day = _day("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_add(day, 30).cast("string").alias("due"), F.trunc(day, "month").cast("string").alias("month"), F.datediff(F.lit("2001-12-31").cast("date"), day).cast("long").alias("age"),
        F.month(day).cast("long").alias("m"), classify.season(F.month(day)).alias("season"), F.last_day(day).cast("string").alias("month_end"),
    )


@query("""
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, case when cast(json_extract_string(props, '$.k') as bigint) >= 50 then 'high' else 'low' end as side, round(ln(1 + value), 6) as logged, round(sqrt(value), 6) as root, least(greatest(value, 10), 60) as clamped from events
""")
def json_and_math_scalars(spark: SparkSession, d: str) -> DataFrame:
    """FN-14, FN-17: JSON fields, logarithms and clamps."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k >= 50, "high").otherwise("low").alias("side"), F.round(F.log1p("value"), 6).alias("logged"), F.round(F.sqrt("value"), 6).alias("root"), F.least(F.greatest("value", F.lit(10.0)), F.lit(60.0)).alias("clamped"))


@query("""
with a as (select l_orderkey, list(l_suppkey order by l_suppkey) as s, list_distinct(list(l_returnflag)) as f from lineitem group by 1)
select l_orderkey, len(s) as n, s[1] as least, s[-1] as greatest, len(list_distinct(s)) as n_distinct, array_to_string(list_sort(f), '|') as flags, list_contains(s, 7) as has_7 from a
""")
def array_scalars(spark: SparkSession, d: str) -> DataFrame:
    """FN-15, AGG-06, SET-05: sorted and distinct lists of a group."""
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("s"), F.sort_array(F.collect_set("l_returnflag")).alias("f"))
    return a.select("l_orderkey", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("least"), F.element_at("s", -1).alias("greatest"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"), F.array_join("f", "|").alias("flags"), F.array_contains("s", 7).alias("has_7"))


@query("""
with t as (select o_orderkey, case o_orderkey % 6 when 0 then round(o_totalprice / 1000, 2)::varchar || 'K' when 1 then '1.5M' when 2 then '2B' when 3 then 'junk' when 4 then null else o_totalprice::varchar end as text, o_totalprice from orders)
select o_orderkey, case o_orderkey % 6 when 0 then round(round(o_totalprice / 1000, 2) * 1000, 2) when 1 then 1500000.0 when 2 then 2000000000.0 when 3 then 0.0 when 4 then 0.0 else round(o_totalprice, 2) end as dollars from t
""")
def money_text(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-04: suffixes, plain amounts and junk."""
    k, price = F.col("o_orderkey") % 6, F.col("o_totalprice")
    # the SQL rounds the hundredfold as a double, which may lie below a half that the decimal digits show
    thousands = F.round(price / 1000 * 100, 0) / 100
    text = F.when(k == 0, F.concat(thousands.cast("decimal(18,2)").cast("string"), F.lit("K"))).when(k == 1, "1.5M").when(k == 2, "2B").when(k == 3, "junk").when(k == 5, price.cast("decimal(18,2)").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.round(parsing.money(text), 2).alias("dollars"))


@query("""
with w as (select o_orderkey, extract(month from o_orderdate) as m, least(extract(day from o_orderdate), 28) as dd, date '2001-03-15' as seen from orders)
select o_orderkey, cast(case when make_date(2001, m, dd) <= seen then make_date(2001, m, dd) else make_date(2000, m, dd) end as varchar) as inferred from w
""")
def inferred_years(spark: SparkSession, d: str) -> DataFrame:
    """FN-10: the most recent year that does not lie after the sighting."""
    day = _day("o_orderdate")
    found = parsing.infer_year(F.month(day), F.least(F.day(day), F.lit(28)), F.lit("2001-03-15").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", found.cast("string").alias("inferred"))


@query("""
with w as (select p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z]+')) as t, p_brand, p_retailprice from part)
select array_to_string(list_sort(t), ' ') as key, count(*) as n, count(distinct p_brand) as brands, cast(sum(cast(p_retailprice as decimal(18,2))) as double) as amount from w group by 1
""")
def normalized_name_groups(spark: SparkSession, d: str) -> DataFrame:
    """Names merged by their sorted distinct words."""
    key = F.array_join(F.sort_array(F.array_distinct(names.words(F.col("p_name")))), " ")
    return table(spark, d, "part").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"), aggregates.exact_sum("p_retailprice").alias("amount"))


@query("""
with w as (select p_brand, list_sort(list_distinct(regexp_extract_all(lower(case when p_size < 10 then p_name || ' ' || p_type else p_name end), '[a-z]+'))) as t, min(p_partkey) as id, count(*) as n from part group by 1, 2)
select a.p_brand, a.id as a, b.id as b, a.n as a_rows, b.n as b_rows, len(a.t) / cast(len(list_distinct(list_concat(a.t, b.t))) as double) as similarity from w a join w b on a.p_brand = b.p_brand and a.id <> b.id and len(list_intersect(a.t, b.t)) = len(a.t)
""")
def token_subset_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-21, FN-08: names whose words are all in another name of the brand (small parts carry their type in the name)."""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", names.words(F.when(F.col("p_size") < 10, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name"))).alias("t"))
    return linkage.subset_pairs(rows, "p_brand", "p_partkey", "t")


_APPLICANTS = """
with v as (select p_partkey, p_retailprice, case p_partkey % 8 when 0 then 'CITY OF BURG ' || p_type when 1 then 'Burg ' || lower(p_type) || ', City of' when 2 then 'Burg ' || lower(p_type) || ' City Of (2)' when 3 then 'DO NOT USE - burg ' || lower(p_type) || ' city' when 4 then '(do not use) Burg ' || p_type || ' / Dept. City' when 5 then 'Burg ' || p_type || ' Hwy Dept. / HWY DEPT' when 6 then 'burg ' || p_type || ' Co Op & Svcs' else 'Town of Burg ' || p_type || ' (DUPLICATE)' end as name,
p_brand || '|' || case when p_partkey % 8 < 4 then 'city of burg ' || lower(p_type) when p_partkey % 8 = 4 then 'city of burg ' || lower(p_type) || ' department' when p_partkey % 8 = 5 then 'burg ' || lower(p_type) || ' highway department' when p_partkey % 8 = 6 then 'burg ' || lower(p_type) || ' cooperative services' else 'town of burg ' || lower(p_type) end as key from part)
"""


def _applicants(spark: SparkSession, d: str) -> DataFrame:
    """Parts as applicants of a county (the brand) whose names are spelled in many ways."""
    k, low = F.col("p_partkey") % 8, F.lower("p_type")
    spelled = [
        F.concat(F.lit("CITY OF BURG "), "p_type"), F.concat(F.lit("Burg "), low, F.lit(", City of")), F.concat(F.lit("Burg "), low, F.lit(" City Of (2)")), F.concat(F.lit("DO NOT USE - burg "), low, F.lit(" city")),
        F.concat(F.lit("(do not use) Burg "), "p_type", F.lit(" / Dept. City")), F.concat(F.lit("Burg "), "p_type", F.lit(" Hwy Dept. / HWY DEPT")), F.concat(F.lit("burg "), "p_type", F.lit(" Co Op & Svcs")), F.concat(F.lit("Town of Burg "), "p_type", F.lit(" (DUPLICATE)")),
    ]
    name = F.get(F.array(*spelled), k.cast("int"))
    return table(spark, d, "part").select("p_partkey", "p_retailprice", name.alias("name"), F.concat_ws("|", "p_brand", names.applicant_key(name)).alias("key"))


@query(_APPLICANTS + "select p_partkey, name, key from v")
def applicant_keys(spark: SparkSession, d: str) -> DataFrame:
    """UDF-01: names without marks, record numbers and repeated endings, abbreviations spelled out, kinds of places in front."""
    return _applicants(spark, d).select("p_partkey", "name", "key")


@query(_APPLICANTS + """,
n as (select key, name, sum(cast(p_retailprice as decimal(18,2))) as a, count(*) as n from v group by 1, 2),
r as (select *, row_number() over (partition by key order by not regexp_matches(name, '(?i)do not use|duplicate') desc, regexp_matches(name, '[a-z]') and regexp_matches(name, '[A-Z]') desc, n desc, a desc, length(name), name) as r from n)
select key, count(*) as variants, cast(sum(n) as bigint) as n, cast(sum(a) as double) as amount, max(name) filter (r = 1) as display from r group by 1
""")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """UDAF-02: variants of a key with totals and the best display name: not marked, with small letters, of most rows, dearest, shortest."""
    return linkage.merged(_applicants(spark, d), "key", "name", "p_retailprice")


@query("""
with q as (select * from embeddings where vec_id % 100 = 0),
w as (select q.vec_id as query, e.vec_id as neighbour, round(exp(-list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) / 2.0) + case when e.label is not distinct from q.label then 0.1 else 0.0 end, 9) as weight from embeddings e join q on e.vec_id <> q.vec_id)
select query, neighbour, weight, rank from (select *, cast(row_number() over (partition by query order by weight desc, neighbour) as int) as rank from w) where rank <= 5
""")
def knn_gaussian_analogs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-28: the five nearest analogs of a stated query set, against all rows."""
    rows = table(spark, d, "embeddings")
    return similarity.analogs(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", "label")


@query("""
with recursive e as (select 'r' || r_regionkey as src, 'n' || n_nationkey as dst from nation join region on r_regionkey = n_regionkey union all select 'n' || s_nationkey, 's' || s_suppkey from supplier),
c as (select 'r' || r_regionkey as root, 'r' || r_regionkey as node, 0 as depth from region union all select root, dst, depth + 1 from c join e on src = node)
select root, count(*) as nodes, max(depth) as depth, max(case when s_acctbal < -900 then 2 when s_acctbal < 0 then 1 when s_acctbal is not null then 0 end) as worst, count(s_suppkey) as inputs from c left join supplier on node = 's' || s_suppkey group by 1
""")
def recursive_cone(spark: SparkSession, d: str) -> DataFrame:
    """GRF-03: everything downstream of a region, and the worst health of anything in it."""
    n, s, r = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "region")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).unionByName(s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst")))
    found = graph.cone(edges, r.select(F.concat(F.lit("r"), "r_regionkey").alias("node")))
    rank = F.when(F.col("s_acctbal") < -900, 2).when(F.col("s_acctbal") < 0, 1).otherwise(0)
    worst = graph.worst_input(found, s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), rank.alias("rank")))
    return found.groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth")).join(worst, "root", "left")


@query("""
with nodes as (select 'n' || n_nationkey as node from nation where n_regionkey <> 0 union all select 's' || s_suppkey from supplier where s_acctbal >= 1000), e as (select 'n' || s_nationkey as src, 's' || s_suppkey as dst from supplier where s_acctbal < 8000),
x as (select src as node from e union select dst from e)
select 'dangling' as rule, node from x where node not in (select node from nodes) union all select 'orphan', node from nodes where node not in (select node from x)
""")
def graph_violations(spark: SparkSession, d: str) -> DataFrame:
    """GRF-02: edge ends that are no node, nodes without edges."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    nodes = n.where("n_regionkey <> 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node")).unionByName(s.where("s_acctbal >= 1000").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    edges = s.where("s_acctbal < 8000").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return graph.violations(nodes, edges)


@query("""
select c_mktsegment, o_orderstatus, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amount, grouping(c_mktsegment, o_orderstatus) as level from orders join customer on c_custkey = o_custkey group by cube (c_mktsegment, o_orderstatus)
""")
def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    """CUBE over segment and status."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.cube("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), aggregates.exact_sum("o_totalprice").alias("amount"), F.grouping_id().alias("level"))


@query("""
select cast(time_bucket(interval 6 hours, ts) as varchar) as begin_ts, event_type, count(*) as n, max(value) as peak from events group by 1, 2
""")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    """STR-09: six-hour windows."""
    out = table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begin_ts"), "event_type", "n", "peak")


@query("""
with w as (select event_id, event_type, unnest([time_bucket(interval 12 hours, ts), time_bucket(interval 12 hours, ts) - interval 12 hours]) as s from events)
select cast(s as varchar) as begin_ts, event_type, count(*) as n from w group by 1, 2
""")
def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    """STR-09: windows of a day, every twelve hours."""
    out = table(spark, d, "events").groupBy(F.window("ts", "24 hours", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("begin_ts"), "event_type", "n")


@query("""
with l as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from l)
select user_id, cast(cast(min(epoch_us(ts)) as bigint) as bigint) as begin_us, cast(max(epoch_us(ts)) as bigint) as end_us, count(*) as n from r group by user_id, s
""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """STR-07: readings of a user less than six hours apart are one episode."""
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return windows.sessions(rows, ["user_id"], "at", "6 hours").select("user_id", F.unix_micros("begin_ts").alias("begin_us"), F.unix_micros("end_ts").alias("end_us"), "n")


@query("""
with m as (select event_type, median(value) as med from events group by 1), o as (select e.*, med, abs(value - med) as dv from events e join m using (event_type)), s as (select event_type, median(dv) as mad from o group by 1)
select event_id, event_type, value from o join s using (event_type) where mad > 0 and 0.6745 * (value - med) / mad > 1.2 and value > 2 * med
""")
def modified_z_outliers(spark: SparkSession, d: str) -> DataFrame:
    """WIN-14: high readings by median and MAD."""
    return windows.outliers(table(spark, d, "events"), ["event_type"], "value", 1.2).select("event_id", "event_type", "value")


@query("""
with c as (select l_orderkey, count(*) as n, max(l_linenumber) as stated, sum(x) as total, sum(case when l_discount > 0 then x end) as sorted, sum(case when l_shipdate < timestamp '2001-06-01' then x end) as dated,
sum(case when l_returnflag = 'A' then x end) as ha, sum(case when l_returnflag = 'R' then x end) as ona, sum(case when l_linestatus = 'F' then x end) as ab, max(l_linestatus) as mirror from (select *, cast(l_extendedprice as decimal(18,2)) as x from lineitem) group by 1),
o as (select c.*, cast(o_totalprice as decimal(18,2)) as pa, o_orderstatus from c join orders on o_orderkey = l_orderkey),
r as (select 'count' as rule, l_orderkey as k, cast(stated as decimal(38,2)) as a, cast(n as decimal(38,2)) as b, stated <> n as broken from o
union all select 'by year', l_orderkey, pa, coalesce(dated, 0), coalesce(dated, 0) - pa > greatest(5, 0.005 * greatest(pa, 1)) from o where dated is not null
union all select 'breakdown', l_orderkey, total, sorted, abs(total - sorted) > greatest(5, 0.005 * greatest(total, 1)) from o where sorted is not null
union all select 'two parts', l_orderkey, total, coalesce(ha, 0) + coalesce(ona, 0), abs(total - coalesce(ha, 0) - coalesce(ona, 0)) > 1 from o where ha is not null or ona is not null
union all select 'within', l_orderkey, pa, coalesce(ab, 0), coalesce(ab, 0) - pa > 1 from o
union all select 'mirror', l_orderkey, cast(case when o_orderstatus = 'P' then null when o_orderstatus <> mirror then 1 else 0 end as decimal(38,2)), 0, o_orderstatus <> mirror from o where o_orderstatus <> 'P')
select rule, count(*) as checked, count(*) filter (broken) as broken, round(cast(sum(a - b) as double), 2) as net, max({'g': round(cast(abs(a - b) as double), 2), 'k': k}) filter (broken)['k'] as worst, round(cast(max(abs(a - b)) filter (broken) as double), 2) as worst_gap from r group by 1
""".replace("max({'g': round(cast(abs(a - b) as double), 2), 'k': k}) filter (broken)['k']", "arg_max(k, {'g': round(cast(abs(a - b) as double), 2), 'k': k}) filter (broken)"))
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """AUD-01, AUD-03, AUD-04, AUD-06: counts, years, breakdowns and parts of every order against what it states, within the tolerances, in one aggregation."""
    x, flag = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_returnflag")

    def of(test):
        return F.sum(F.when(test, x))

    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.max("l_linenumber").alias("stated"), F.sum(x).alias("total"), of(F.col("l_discount") > 0).alias("sorted"), of(F.col("l_shipdate") < F.lit("2001-06-01").cast("timestamp_ntz")).alias("dated"),
        of(flag == "A").alias("ha"), of(flag == "R").alias("ona"), of(F.col("l_linestatus") == "F").alias("ab"), F.max("l_linestatus").alias("mirror"),
    )
    rows = lines.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("pa", F.col("o_totalprice").cast("decimal(18,2)"))
    none = F.lit(0).cast("decimal(38,2)")
    pa, total, dated, parts, ab = F.col("pa"), F.col("total"), F.coalesce("dated", none), F.coalesce("ha", none) + F.coalesce("ona", none), F.coalesce("ab", none)
    other = F.col("o_orderstatus") != F.col("mirror")
    rules = {
        "count": (F.col("stated"), F.col("n"), F.col("stated") != F.col("n")),
        "by year": (pa, dated, F.when(F.col("dated").isNotNull(), dated - pa > buckets.tolerance(pa))),
        "breakdown": (total, F.col("sorted"), F.abs(total - F.col("sorted")) > buckets.tolerance(total)),
        "two parts": (total, parts, F.when(F.col("ha").isNotNull() | F.col("ona").isNotNull(), F.abs(total - parts) > 1)),
        "within": (pa, ab, ab - pa > 1),
        "mirror": (F.when(other, 1).otherwise(0), none, F.when(F.col("o_orderstatus") != "P", other)),
    }
    return buckets.audit(rows, "l_orderkey", rules)


@query("""
with p as (select l_orderkey as k, sum(cast(l_extendedprice as decimal(18,2))) as parts from lineitem group by 1), s as (select o_orderkey as k, cast(o_totalprice as decimal(18,2)) as stated from orders)
select k, cast(coalesce(stated, 0) as double) as stated, cast(coalesce(parts, 0) as double) as parts, cast(coalesce(stated, 0) - coalesce(parts, 0) as double) as residual, abs(coalesce(stated, 0) - coalesce(parts, 0)) > cast(0.25 as double) * abs(coalesce(stated, 0)) as flagged from s full join p using (k)
""")
def residual_audit(spark: SparkSession, d: str) -> DataFrame:
    """AUD-02, AUD-05: parts against stated totals, gaps flagged."""
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice")
    totals = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return buckets.gap(parts, totals, ["k"], "l_extendedprice", "o_totalprice", 0.25)


@query("""
with x as (select c_custkey, c_acctbal > 0 as prog, count(o_orderkey) as reg, coalesce(sum(case when o_orderstatus = 'F' then o_totalprice end), 0) as amount from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT' group by 1, 2)
select state, count(*) as n from (select case when prog and amount > 0 then 'IHP_WITH_AWARDS' when prog and reg > 0 then 'IHP_NO_AWARDS' when prog then 'IA_ONLY' when amount > 0 or reg > 0 then 'IA_ONLY_ANOMALY' else 'NONE' end as state from x) group by 1
""")
def assistance_states(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-22: five states of assistance."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("reg"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("amount"))
    state = classify.assistance_state(F.col("c_acctbal") > 0, F.col("reg"), F.col("amount"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""
select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 8) as share, round(percent_rank() over (partition by o_orderpriority order by o_totalprice), 8) as standing,
cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey) as double) as running from orders
""")
def shares_and_standing(spark: SparkSession, d: str) -> DataFrame:
    """WIN-15, WIN-16, DOC-07: share of a group, percent rank and running total."""
    by = Window.partitionBy("o_custkey")
    run = by.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = aggregates.percent_ranks(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "standing")
    return ranked.select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(by), 8).alias("share"), F.round("standing", 8).alias("standing"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(run).cast("double").alias("running"))


@query("""
with t as (select l_suppkey, cast(sum(round(l_extendedprice)) as double) as sum_of_rounded, round(cast(sum(cast(l_extendedprice as decimal(18,2))) as double)) as rounded_sum from lineitem group by 1) select * from t
""")
def rounded_parts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-31: a sum of rounded parts is not the rounded sum."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.round("l_extendedprice")).alias("sum_of_rounded"), F.round(aggregates.exact_sum("l_extendedprice")).alias("rounded_sum"))


@query("""
select c_custkey, c_name from customer where c_acctbal > 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') order by c_acctbal desc, c_custkey limit 5
""")
def filtered_top_k(spark: SparkSession, d: str) -> DataFrame:
    """SRT-03: filter first, then the five largest."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").where("c_acctbal > 0").join(done, "c_custkey", "left_anti").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select("c_custkey", "c_name")


@query("""
select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 300000)
""")
def resumable_keys(spark: SparkSession, d: str) -> DataFrame:
    """SRC-25: keys that a resumed pull still has to fetch."""
    return fresh_keys(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""
with f as (select n_nationkey, first_value(s_suppkey) over (partition by n_nationkey order by s_suppkey) as s from nation left join supplier on s_nationkey = n_nationkey)
select distinct n_nationkey, s as first_supplier from f
""")
def first_wins_dimension(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-17: the first supplier of every nation, null without one."""
    first = joins.keep_first(table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("first_supplier")), ["n_nationkey"], "first_supplier")
    return table(spark, d, "nation").select("n_nationkey").join(first, "n_nationkey", "left")


@query("""
with c as (select conv_id, turn, role, length(text) as n, lag(role) over (partition by conv_id order by turn) as before from conversations)
select conv_id, count(*) as turns, count(*) filter (role = before) as repeated, cast(sum(n) as bigint) as chars, min(role) filter (turn = 0) as opened_by from c group by 1
""")
def ordered_turns(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rows of a key: lengths, repeats and who began."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("before", F.lag("role").over(w))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == F.col("before")).alias("repeated"), F.sum(F.length("text")).cast("long").alias("chars"), F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("opened_by"))


@query("""
select page_id, lower(split_part(split_part(url, '://', 2), '/', 1)) as host, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, cast(len(regexp_extract_all(html, '<li>')) as bigint) as items from pages
""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17, FN-06: fields of raw pages by pattern."""
    host = F.lower(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("items"))


@query("""
select o_orderpriority, o_orderstatus, count(*) as n from orders where o_orderdate >= timestamp '2001-08-01' - interval 400 days group by 1, 2
""")
def trailing_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """WIN-17: rows of the 400 days before a stated date; the bound is pushed to the scan."""
    return table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '2000-06-27 00:00:00'").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query()
def standardize_and_logistic(spark: SparkSession, d: str) -> DataFrame:
    """AGG-35, ML-01, ML-07: a logistic model on standardized columns and its calibration by bins."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").alias("length")).join(table(spark, d, "labels"), "doc_id")
    rows = rows.select("doc_id", F.log1p("n_chars").alias("size"), (F.col("length") % 97).cast("double").alias("noise"), "quality")
    weights = learning.logistic(rows, ["size", "noise"], "quality")
    if weights is None:
        return spark.createDataFrame([], "bin int, n long, predicted double, observed double")
    return learning.calibration(learning.scored(rows, ["size", "noise"], weights), "p", "quality")
