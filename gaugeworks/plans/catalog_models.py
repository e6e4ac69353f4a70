"""Queries of fitted models: folds, robust costs, two-part costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import aggregates, fits, learning, similarity
from gaugeworks.sources import scratch
from gaugeworks.sources.readers import table

from .catalog import query
from .catalog_rollups import _O, _orders

_X, _Y = "ln(10 + abs(c_acctbal))", "ln(1 + o_totalprice)"


@query(f"""
with r as (select cast(c_nationkey as varchar) as g, cast(year(o_orderdate) as varchar) as p, {_X} as x, {_Y} as y from {_O}),
fold as (select 'left out' as fold, g as held from r group by g union all select 'forward', p from (select p, row_number() over (order by p) as k from r group by p) where k > 3),
line as (select fold, held, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from fold join r on (fold = 'left out' and g <> held) or (fold = 'forward' and p < held) group by 1, 2)
select fold, held, round(slope, 5) as slope, round(intercept, 4) as intercept, count(*) as n, round(avg((y - intercept - slope * x) ** 2), 6) as error from line join r on (fold = 'left out' and g = held) or (fold = 'forward' and p = held) group by fold, held, slope, intercept
""")
def left_out_lines(spark: SparkSession, d: str) -> DataFrame:
    """ML-06: cost lines of folds that leave out a state, or learn from earlier years only, from sums of one scan."""
    x, y = F.log(10 + F.abs("c_acctbal")), F.log1p("o_totalprice")
    rows = _orders(spark, d).select(x.alias("x"), y.alias("y"), F.col("c_nationkey").alias("state"), F.year("o_orderdate").alias("year"))
    found = fits.left_out_lines(rows, "x", "y", "state", "year")
    return found.select("fold", "held", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), "n", F.round("error", 6).alias("error"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a label that depends on two columns and on much else."""
    luck = F.crc32(F.col("o_orderkey").cast("string").cast("binary")) % 1000 / 1000.0
    chance = F.col("o_totalprice") / 400_000 + F.col("c_acctbal") / 20_000
    rows = _orders(spark, d).select("o_orderkey", F.col("c_nationkey").alias("state"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("size"), F.col("c_acctbal").alias("balance"), (chance + luck > 1.3).cast("int").alias("declared"))
    return aggregates.standardized(rows, ["size", "balance"])


@query()
def refitted_folds(spark: SparkSession, d: str) -> DataFrame:
    """ML-06, ML-07: logistic models refitted without each state and on earlier years only; calibration of what they say of the held-out rows."""
    rows, columns = _labelled(spark, d), ["size", "balance"]
    folds = {"left out": fits.left_out(rows, columns, "declared", "state"), "forward": fits.forward(rows, columns, "declared", "year")}
    found = None
    for name, held in folds.items():
        bins = learning.calibration(held.where("p is not null"), "p", "declared").withColumn("fold", F.lit(name))
        found = bins if found is None else found.unionByName(bins)
    return found


@query()
def robust_costs(spark: SparkSession, d: str) -> DataFrame:
    """ML-08: Huber regression of logarithmic costs for each state, its fit and spread; refused under 20 rows."""
    rows = table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("s_nationkey").alias("state"), F.log("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).otherwise(0.0).alias("paid"))
    return fits.robust_costs(scratch.written(rows, "costs"), ["quantity", "discount"], "paid", "state")


@query("""
with r as (select c_nationkey as state, ln(1 + o_totalprice) - avg(ln(1 + o_totalprice)) over () as left_over from orders join customer on c_custkey = o_custkey),
g as (select state, count(*) as n, avg(left_over) as mean, var_pop(left_over) as v from r group by 1),
s as (select count(*) as g, sum(n) as n, sum(n * n) as nn, sum(n * v) / (sum(n) - count(*)) as s2, sum(n * mean * mean) as b from g),
t as (select s2, greatest((b - (g - 1) * s2) / (n - nn / cast(n as double)), 0) as t2 from s)
select state, n, round(mean, 7) as mean, round(case when t2 > 0 then n / (n + s2 / t2) * mean else 0 end, 7) as effect from g, t
""")
def pooled_state_effects(spark: SparkSession, d: str) -> DataFrame:
    """DOC-18: what states cost beyond the rest, shrunk by how little each of them tells."""
    rows = _orders(spark, d).select(F.col("c_nationkey").alias("state"), F.log1p("o_totalprice").alias("y"))
    mean = rows.agg(F.avg("y").alias("m"))
    found = fits.pooled_effects(rows.join(F.broadcast(mean)).withColumn("left_over", F.col("y") - F.col("m")), "state", "left_over")  # one row
    return found.select("state", "n", F.round("mean", 7).alias("mean"), F.round("effect", 7).alias("effect"))


@query()
def two_part_costs(spark: SparkSession, d: str) -> DataFrame:
    """DOC-18: hurdle (Firth's logistic part, logarithmic amounts, pooled states) beside a Tweedie model, by state."""
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))))
    paid = table(spark, d, "orders").groupBy("o_custkey").agg(urgent.alias("paid"), F.count("*").alias("requests"))
    rows = table(spark, d, "customer").join(paid, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.select("c_custkey", F.col("c_nationkey").alias("state"), "c_acctbal", F.coalesce("requests", F.lit(0)).cast("double").alias("requests"), (F.col("paid") * (1 + F.col("c_nationkey") % 5 / 4)).alias("paid"))
    rows = aggregates.standardized(rows.withColumn("balance", F.col("c_acctbal").cast("double")).drop("c_acctbal"), ["requests", "balance"])
    found = fits.hurdle_costs(scratch.written(rows, "costs"), ["requests", "balance"], "paid", "state")  # every model reads the rows
    parts = [F.round(F.avg(c), 4).alias(c) for c in ("p", "effect", "expected", "tweedie")]
    return found.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("paid") > 0).alias("positive"), F.round(F.avg(F.coalesce("paid", F.lit(0.0))), 4).alias("observed"), *parts)


@query("""
with q as (select * from embeddings where vec_id % 100 = 0),
w as (select q.vec_id as query, e.vec_id as neighbour, round(exp(-list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) / 2.0) + case when e.label is not distinct from q.label then 0.1 else 0.0 end, 9) as weight from embeddings e join q on e.vec_id <> q.vec_id),
n as (select * from (select *, row_number() over (partition by query order by weight desc, neighbour) as r from w) where r <= 20),
f as (select c_custkey as k, sum(cast(o_totalprice as decimal(18,2))) as amount, case when c_custkey % 10 = 3 then 0 else 100 + c_custkey % 900 end as people from customer left join orders on o_custkey = c_custkey group by 1),
h as (select query, neighbour, weight, cast(amount as double) / people as x from n join f on k = neighbour where people > 0 and amount is not null),
r as (select *, sum(weight) over (partition by query order by x, neighbour rows unbounded preceding) as upto, sum(weight) over (partition by query) as whole from h),
s as (select query, count(*) as analogs, min(x) filter (upto >= 0.1 * whole) as low, min(x) filter (upto >= 0.5 * whole) as typical, min(x) filter (upto >= 0.9 * whole) as high, sum(weight * x) / sum(weight) as expected from r group by 1)
select query, analogs, round(low * people, 4) as low, round(typical * people, 4) as typical, round(high * people, 4) as high, round(expected * people, 4) as expected from s join f on k = query
""")
def nearest_intervals(spark: SparkSession, d: str) -> DataFrame:
    """DOC-02: weighted interval of the costs a head of the 20 nearest analogs, scaled to the people of each query."""
    rows = table(spark, d, "embeddings")
    near = similarity.analogs(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", "label", keep=20)
    paid = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    facts = table(spark, d, "customer").join(paid, "c_custkey", "left").select("c_custkey", "amount", F.when(F.col("c_custkey") % 10 == 3, 0).otherwise(100 + F.col("c_custkey") % 900).alias("people"))
    found = similarity.suggested(near, facts, facts, "c_custkey", "c_custkey", "amount", "people")
    return found.select("query", "analogs", *(F.round(c, 4).alias(c) for c in ("low", "typical", "high", "expected")))
