"""Record linkage of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import names


def subset_pairs(rows: DataFrame, block: str, id_col: str, tokens: str) -> DataFrame:
    """(block, a, b, a_rows, b_rows, similarity): where all tokens of ``a`` are among those of ``b``, with their Jaccard similarity.

    Rows of equal token sets are one class, which stands under its least id with
    its number of rows, so copies are never paired.  A class meets others by its
    rarest token only: that token must be in ``b`` too, so blocks are not paired
    with themselves, and common tokens join little.  Rows without tokens pair
    with nothing.
    """
    classes = rows.groupBy(block, F.sort_array(F.array_distinct(tokens)).alias("_s")).agg(F.min(id_col).alias("_id"), F.count("*").alias("_rows"))
    each = classes.withColumn("_t", F.explode("_s"))
    rarity = each.groupBy(block, "_t").agg(F.count("*").alias("_n"))
    rarest = each.join(rarity, [block, "_t"]).groupBy(block, F.col("_id").alias("a")).agg(F.min_by("_t", F.struct("_n", "_t")).alias("_t"), F.first("_s").alias("_a"), F.first("_rows").alias("a_rows"))
    b = each.select(block, F.col("_id").alias("b"), F.col("_s").alias("_b"), F.col("_rows").alias("b_rows"), "_t")
    inside = F.size(F.array_except("_a", "_b")) == 0
    return rarest.join(b, [block, "_t"]).where((F.col("a") != F.col("b")) & inside).select(block, "a", "b", "a_rows", "b_rows", (F.size("_a") / F.size("_b")).alias("similarity"))


def merged(rows: DataFrame, key: str, name: str, amount: str, overrides: DataFrame | None = None) -> DataFrame:
    """Groups of rows by key with their variants, total and best display name.

    ``overrides`` (name, target) replaces keys first.  The best name is not
    marked as retired, then has capitals and small letters, then the most rows,
    then the largest amount, then is shortest, then first in the alphabet.
    """
    if overrides is not None:
        rows = rows.join(overrides.select(F.col("name").alias(name), "target"), name, "left").withColumn(key, F.coalesce("target", key)).drop("target")
    mixed = F.col(name).rlike("[a-z]") & F.col(name).rlike("[A-Z]")
    per_name = rows.groupBy(key, name).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("_a"), F.count("*").alias("_n"))
    order = F.struct((~names.retired(F.col(name))).alias("_u"), mixed.alias("_m"), "_n", "_a", (-F.length(name)).alias("_l"))
    ties = per_name.withColumn("_o", order)
    best = ties.groupBy(key).agg(F.max("_o").alias("_o"))
    shown = ties.join(best, [key, "_o"]).groupBy(key).agg(F.min(name).alias("display"))
    total = per_name.groupBy(key).agg(F.count("*").alias("variants"), F.sum("_n").alias("n"), F.sum("_a").cast("double").alias("amount"))
    return total.join(shown, key)
