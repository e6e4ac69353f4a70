"""Aggregations.  All combine partially before the shuffle unless they need sorted values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.classify import band
from gaugeworks.operators.ranges import running


def exact_sum(x: Column | str) -> Column:
    """Sum of cents, the same in any order, as a double."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def mode_first(rows: DataFrame, group: Sequence[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group, ties to the value seen first by ``order``."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("_seen"))
    return counted.groupBy(*group).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("_seen"))).alias("_m")).select(*group, "_m.*")


def grouping_sets(rows: DataFrame, sets: Sequence[Sequence[str]], *aggs: Column) -> DataFrame:
    """Aggregates of several groupings in one pass; columns outside a grouping are null, ``level`` is the grouping id."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*aggs, F.grouping_id().alias("level"))


def percentiles(rows: DataFrame, group: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation; nulls are dropped, a group of nulls alone has null percentiles.

    Values are counted first and ranked by ranges, so no task holds a group's values.
    """
    v = F.col(value).cast("double")
    by_value = rows.where(F.col(value).isNotNull()).groupBy(*group, v.alias("_v")).agg(F.count("*").alias("_c"))
    sizes = rows.groupBy(*group).agg(F.count(value).alias("n"))
    ranked = running(by_value, group, "_v", ["_c"]).join(sizes, list(group))

    def at_rank(r: Column) -> Column:
        return F.max(F.when((r < F.col("_c_upto")) & (r >= F.col("_c_upto") - F.col("_c")), F.col("_v")))

    picks = []
    for k, p in at.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        picks += [at_rank(F.floor(place)).alias(f"_lo_{k}"), at_rank(F.ceil(place)).alias(f"_hi_{k}")]
    found = ranked.groupBy(*group).agg(*picks)
    between = [(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * ((F.col("n") - 1) * F.lit(float(p)) % 1)).alias(k) for k, p in at.items()]
    return sizes.join(found, list(group), "left").select(*group, "n", *between)


def percent_ranks(rows: DataFrame, group: Sequence[str], value: str, to: str) -> DataFrame:
    """``rows`` with ``to``: the share of the group's other rows whose value is smaller; 0 in a group of one, null for a null value.

    Values are counted and ranked by ranges, so neither a hot group nor the
    whole table is one task.
    """
    by_value = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    sizes = by_value.groupBy(*group).agg(F.sum("_c").alias("_n"))
    ranked = running(by_value, group, value, ["_c"]).join(sizes, list(group))
    place = F.when(F.col("_n") > 1, (F.col("_c_upto") - F.col("_c")) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return rows.join(ranked.select(*group, value, place.alias(to)), [*group, value], "left")


def upper_median(rows: DataFrame, group: Sequence[str], value: str, name: str = "upper_median") -> DataFrame:
    """Middle value, the upper one of an even count; values are counted and ranked by ranges."""
    by_value = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    sizes = rows.groupBy(*group).agg(F.count(value).alias("_n"))
    ranked = running(by_value, group, value, ["_c"]).join(sizes, list(group))
    return ranked.where("floor(_n / 2) >= _c_upto - _c and floor(_n / 2) < _c_upto").select(*group, F.col(value).alias(name))


def rank_auc(rows: DataFrame, value: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive row exceeds a negative one, ties half; null without both classes.

    Values are counted first and ranked by ranges of values, so no task holds all
    of them; equal values get their mean rank from the running count.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    by_value = rows.groupBy(*group, v.alias("_v")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    wins = running(by_value, group, "_v", ["_n"]).withColumn("_w", F.col("_p") * (2 * F.col("_n_upto") - F.col("_n")))
    total = wins.groupBy(*group).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum("_w").alias("_w"))
    pairs = 2.0 * F.col("positives") * F.col("negatives")
    return total.select(*group, "positives", "negatives", F.when(pairs > 0, F.round(F.col("_w") / pairs, 6)).alias("auc"))


def binned_rate(rows: DataFrame, value: str, label: str, edges: Sequence[float], null_as_zero: bool = False) -> DataFrame:
    """n, positives and rate of every bin, empty bins included with a null rate."""
    spark = rows.sparkSession
    bins = spark.createDataFrame([(i,) for i in range(len(edges))], "bin int")
    counted = rows.groupBy(band(F.col(value), edges, null_as_zero).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    filled = bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"))
    return filled.withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("positives") / F.col("n"), 3)))


def top_per_group(rows: DataFrame, group: Sequence[str], item: str, amount: Column, keep: int) -> DataFrame:
    """The ``keep`` largest items of each group, with the group's number of items."""
    total = rows.groupBy(*group, item).agg(exact_sum(amount).alias("amount"))
    w = Window.partitionBy(*group)
    ranked = total.withColumn("items", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("amount"), item)))
    return ranked.where(F.col("rank") <= keep)


def allocate(totals: DataFrame, weights: DataFrame, key: str, total: str, weight: str) -> DataFrame:
    """Each key's total over its weight rows in proportion, evenly where the weights sum to 0."""
    whole = weights.groupBy(key).agg(F.sum(weight).alias("_whole"), F.count("*").alias("_parts"))
    share = F.when(F.col("_whole") > 0, F.col(weight) / F.col("_whole")).otherwise(1 / F.col("_parts"))
    return weights.join(totals, key).join(whole, key).withColumn("allocated", F.col(total) * share).drop("_whole", "_parts")


def standardized(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0)."""
    stats = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        joined = joined.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0))
    return joined.select(*rows.columns)


def scopes(rows: DataFrame, levels: Sequence[str], names: Sequence[str], amount: str) -> DataFrame:
    """(scope, levels.., n, amount, holds): rows and exact amounts of all rows and of each level below.

    ``names`` are the scopes from all rows down.  Rows without a value of a level
    belong to the scopes above it only; ``holds`` tells whether the amounts of
    the scopes just below add up to a scope's own, and is true at the bottom.
    One aggregation at the finest grain; the scopes above are sums of its rows.
    """
    fine = rows.groupBy(*levels).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))
    out = None
    for depth, name in enumerate(names):
        keys, below = list(levels[:depth]), levels[depth : depth + 1]
        placed = F.expr(" and ".join(f"{k} is not null" for k in below) or "true")
        whole = fine.where(" and ".join(f"{k} is not null" for k in keys) or "true").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.sum(F.when(placed, F.col("amount"))).alias("_below"))
        rest = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in levels[depth:]]
        part = whole.select(F.lit(name).alias("scope"), *keys, *rest, "n", "amount", (F.coalesce("_below", F.lit(0)) == F.col("amount")).alias("holds"))
        out = part if out is None else out.unionByName(part)
    return out
