"""Queries of documents without a schema, and of listings searched by parts of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import payloads
from gaugeworks.operators import containment
from gaugeworks.sources.readers import table

from .catalog import query

_LABELS = ["5-min", "60-min", "1-day", "2-day"]


@query("""
with k(k, i, days, fine) as (values (0, 1, 1, true), (0, 2, 2, true), (1, 2, 1, true), (1, 3, 2, true), (2, 2, 1, true), (2, 3, 2, true), (4, 1, 7, true), (5, 0, 3, true), (5, 2, 30, true))
select p_partkey, days, cast(p_size + i as double) as first_depth, round(p_retailprice * (i + 1), 4) as last_depth from part join k on p_partkey % 6 = k
""")
def script_matrices(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17: nested lists out of script payloads; labels from the payload or the standard ones.

    Payloads of a part: whole; without labels; with too few labels; cut off; with
    brackets in quotes; with a row that holds no number.
    """
    k = F.col("p_partkey") % 6

    def row(n: int):
        return F.concat(F.lit("["), F.col("p_size") + n, F.lit(",'"), F.round(F.col("p_retailprice") / 2, 4), F.lit("', "), F.round(F.col("p_retailprice") * (n + 1), 4), F.lit("]"))

    three, four = (F.concat(F.lit("quantiles = ["), F.concat_ws(",\n ", *map(row, range(n))), F.lit("]; ")) for n in (3, 4))
    text = (
        F.when(k == 0, F.concat(F.lit("var q; // [\n"), three, F.lit("durations = ['5-min', '1-day', \"2-day\"];")))
        .when(k == 1, four)
        .when(k == 2, F.concat(four, F.lit("durations = ['1-day','2-day'];")))
        .when(k == 3, F.concat(F.lit("durations = ['1-day','2-day','3-day']; "), F.substring_index(three, "]", 3)))
        .when(k == 4, F.concat(F.lit("durations = ['1-day]', '7-Day', '[[2']; "), three))
        .otherwise(F.concat(F.replace(three, F.concat(F.lit("["), F.col("p_size") + 1, F.lit(",")), F.lit("['n/a',")), F.lit("durations=['3-day','10-day','30day'];")))
    )
    payload = table(spark, d, "part").select("p_partkey", text.alias("script"))
    lists = payload.select("p_partkey", payloads.script_list(F.col("script"), "quantiles", "array<string>").alias("q"), payloads.script_list(F.col("script"), "durations", "string").alias("l"))
    rows = lists.select("p_partkey", F.explode(payloads.labelled_rows(F.col("q"), F.col("l"), _LABELS)).alias("r"))
    depths = rows.select("p_partkey", payloads.whole_days(F.col("r.label")).alias("days"), F.transform("r.row", lambda x: x.try_cast("double")).alias("v"))
    fine = depths.where(F.col("days").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    return fine.select("p_partkey", "days", F.get("v", F.lit(0)).alias("first_depth"), F.element_at("v", -1).alias("last_depth"))


@query("""
with o as (select o_orderkey, o_orderkey % 8 as k, cast(o_orderdate as date) as day, cast(o_orderdate as date) + interval 10 year as later from orders),
f as (select o_orderkey, k, case k when 0 then 'key' when 1 then 'as of' when 2 then 'section' when 3 then 'section' when 4 then 'newest' when 5 then null when 6 then 'key' else 'section' end as way,
case k when 0 then cast(day as varchar) when 1 then cast(day as varchar) when 2 then cast(day as varchar) when 3 then cast(day as varchar)
when 4 then case when cast(later as date) <= date '2009-06-30' then cast(cast(later as date) as varchar) else '2004-02-29' end when 6 then '7' when 7 then cast(day as varchar) end as date from o)
select way, date, count(*) as n, min(o_orderkey) as first_order from f group by 1, 2
""")
def document_freshness(spark: SparkSession, d: str) -> DataFrame:
    """GRF-04, SRC-28: how fresh documents of unknown shape are: by key, by parts, by section, by any date in them."""
    k = F.col("o_orderkey") % 8
    day = F.col("o_orderdate").cast("date").cast("string")
    later = F.add_months(F.col("o_orderdate").cast("date"), 120).cast("string")
    shapes = [
        F.format_string('{"dataAsOf": "", "generated": "%s", "builtAt": "1990-01-01", "asOf": {"x": "2030-01-01"}}', day),
        F.format_string('{"generated": null, "asOf": {"rain": "1990-05-05", "river": "%s", "snow": null, "tide": ""}}', day),
        F.format_string('{"meta": {"n": 4}, "coverage": {"from": "1990-01-01", "to": "%s"}, "rows": ["2008-01-01"]}', day),
        F.format_string('{"meta": {"asOf": {"a": "1991-01-01", "b": "%s"}}, "coverage": {"to": "1990-01-01"}}', day),
        F.format_string('[{"2008-08-08": 1, "seen": "on %s, again"}, [[{"at": ["2004-02-29", "2033-03-03"]}]], "2001-1-1"]', later),
        F.format_string('{"n": %d, "asOf": "soon", "rows": [1, "1999-01-01"]}', F.col("o_orderkey")),
        F.lit('{"dataAsOf": 0, "generatedAt": false, "generated": 7, "meta": {"builtAt": "1990-01-01"}}'),
        F.format_string('{"asOf": {}, "coverage": {"briefDate": "%s", "to": "1990-01-01"}}', day),
    ]
    text = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    docs = table(spark, d, "orders").select("o_orderkey", F.try_parse_json(text).alias("doc"))
    found = docs.select("o_orderkey", payloads.freshness_date(F.col("doc"), F.lit("2009-06-30")).alias("f"))
    return found.groupBy("f.way", "f.date").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("""
with l as (select p_partkey as lid, p_name || ' near ' || p_brand || '/' || cast(p_partkey // 12 as varchar) || ' LOCK' as name, case when p_partkey % 7 = 0 then -1 else p_partkey end as claim from part),
w as (select p_partkey as sid, upper(substr(p_name, 2)) || ' NEAR ' as town, '/' || cast(p_partkey // 12 as varchar) as river from part),
c as (select sid, lid, row_number() over (partition by sid order by lid) as r from w join l on contains(lower(name), lower(town)) and contains(lower(name), lower(river))),
t as (select sid, min(case when claim = sid then r end) as r, count(*) as n from (select c.*, claim from c join l using (lid) where r <= 5) group by 1)
select sid, case when t.r is not null then sid end as lid, t.r::int as rank, coalesce(t.r, n) as tried from t
""")
def listing_then_detail(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13: entries of a listing whose names contain two parts, five at most, the first confirmed by its own details."""
    part = table(spark, d, "part")
    tag = F.concat(F.lit("/"), F.expr("p_partkey div 12"))
    listing = part.select(F.col("p_partkey").alias("lid"), F.concat("p_name", F.lit(" near "), "p_brand", tag, F.lit(" LOCK")).alias("name"))
    details = part.select(F.col("p_partkey").alias("lid"), F.when(F.col("p_partkey") % 7 == 0, -1).otherwise(F.col("p_partkey")).alias("claim"))
    wanted = part.select(F.col("p_partkey").alias("sid"), F.concat(F.upper(F.substr("p_name", F.lit(2))), F.lit(" NEAR ")).alias("town"), tag.alias("river"))
    found = containment.candidates(wanted, listing, "sid", ["town", "river"], "lid", "name")
    return containment.confirmed(found, details, "lid", "claim").select(F.col("query").alias("sid"), F.col("entry").alias("lid"), "rank", "tried")
