"""Lossless bucketing and conservation checks: every row lands in one bucket, every dollar is accounted for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = ("statewide", "unmatched", "undeclared", "in_county")


def bucketed(rows: DataFrame, places: DataFrame, on: Sequence[str], statewide: Column, declared: str) -> DataFrame:
    """Rows with a ``bucket``: statewide, unmatched (no place), undeclared, or in_county; none is dropped.

    ``places`` has one row for each key, with the boolean column ``declared``.
    """
    found = places.withColumn("_found", F.lit(True))
    bucket = (
        F.when(F.coalesce(statewide, F.lit(False)), "statewide")
        .when(F.col("_found").isNull(), "unmatched")
        .when(~F.coalesce(declared, F.lit(False)), "undeclared")
        .otherwise("in_county")
    )
    return rows.join(found, list(on), "left").withColumn("bucket", bucket).drop("_found")


def conservation(rows: DataFrame, group: Sequence[str], bucket: str, amount: str) -> DataFrame:
    """Rows and dollars of each group and bucket next to the group's total and the share."""
    cents = F.sum(F.col(amount).cast("decimal(18,2)"))
    part = rows.groupBy(*group, bucket).agg(F.count("*").alias("n"), cents.alias("amount"))
    whole = part.groupBy(*group).agg(F.sum("n").alias("total_n"), F.sum("amount").alias("total_amount"))
    out = part.join(whole, list(group)) if group else part.crossJoin(F.broadcast(whole))  # one row
    return out.select(*group, bucket, "n", F.col("amount").cast("double").alias("amount"), "total_n", F.col("total_amount").cast("double").alias("total_amount"))


def gap(parts: DataFrame, totals: DataFrame, key: Sequence[str], part: str, total: str, tolerance: float = 0.01) -> DataFrame:
    """Sum of parts against a stated total: residual and whether it is beyond the tolerated share."""
    summed = parts.groupBy(*key).agg(F.sum(F.col(part).cast("decimal(18,2)")).alias("parts"))
    stated = totals.select(*key, F.col(total).cast("decimal(18,2)").alias("stated"))
    joined = stated.join(summed, list(key), "full").select(*key, F.coalesce("stated", F.lit(0)).alias("stated"), F.coalesce("parts", F.lit(0)).alias("parts"))
    residual = F.col("stated") - F.col("parts")
    return joined.select(*key, F.col("stated").cast("double"), F.col("parts").cast("double"), residual.cast("double").alias("residual"), (F.abs(residual) > tolerance * F.abs("stated")).alias("flagged"))


def require(rows: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """``rows``, failing at run time on the first row that breaks a check."""
    out = rows
    for test, message in checks:
        out = out.where(F.coalesce(test, F.lit(False)) | F.raise_error(F.lit(message)).cast("boolean"))
    return out


def anomalies(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each named rule, one row a rule."""
    counted = rows.agg(*(F.count_if(c).alias(k) for k, c in rules.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules))
    return counted.select(F.explode(pairs).alias("r")).select("r.rule", "r.n")


def tolerance(total: Column, least: Column | float = 5) -> Column:
    """What two figures of one thing may differ by: half a percent, ``least`` at least."""
    return F.greatest(F.lit(least) if not isinstance(least, Column) else least, 0.005 * F.greatest(total, F.lit(1)))


def audit(objects: DataFrame, key: str, rules: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(rule, checked, broken, net, worst, worst_gap): figures that ought to agree, all rules in one aggregation.

    A rule is (stated, found, broken): two figures, and a test of them, null
    where the rule does not apply to an object.  ``net`` is what the objects
    state beyond what was found, over all that were checked; ``worst`` the
    broken object with the largest gap, of equals the largest key.
    """
    parts = []
    for i, (stated, found, broken) in enumerate(rules.values()):
        gap = (stated - found).cast("double")
        top = F.max(F.when(broken, F.struct(F.round(F.abs(gap), 2).alias("g"), F.col(key).alias("k"))))
        parts += [F.count(broken).alias(f"_c{i}"), F.count_if(broken).alias(f"_b{i}"), F.round(F.sum(F.when(broken.isNotNull(), (stated - found).cast("decimal(38,2)"))).cast("double"), 2).alias(f"_n{i}"), top.alias(f"_t{i}")]
    sums = objects.agg(*parts)
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"_c{i}").alias("checked"), F.col(f"_b{i}").alias("broken"), F.col(f"_n{i}").alias("net"), F.col(f"_t{i}.k").alias("worst"), F.col(f"_t{i}.g").alias("worst_gap")) for i, r in enumerate(rules)]
    return sums.select(F.inline(F.array(*rows)))


def conserved(expected: Column, fetched: Column, kept: Column, aside: Column, least: int = 2000, share: float = 0.01) -> Column:
    """(conserved, complete): whether every fetched row was kept or set aside, and whether as many came as were announced, give or take."""
    return F.struct((fetched == kept + aside).alias("conserved"), (F.abs(fetched - expected) <= F.greatest(F.lit(least), F.floor(expected * share))).alias("complete"))
