"""Ordered sequences: adjacency, islands, first and last sightings, states, interpolation, dense axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.aggregates import percentiles


def largest_adjacent_drop(series: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Largest fall from one calendar day to the next; a missing day breaks the pair; at least 0."""
    w = Window.partitionBy(*key).orderBy(day)
    fall = F.when(F.datediff(day, F.lag(day).over(w)) == 1, F.lag(value).over(w) - F.col(value)).otherwise(F.lit(0))
    return series.withColumn("_fall", fall).groupBy(*key).agg(F.greatest(F.max("_fall"), F.lit(0)).alias("drop"))


def trailing_sums(series: DataFrame, key: Sequence[str], day: str, value: str, spans: Sequence[int]) -> DataFrame:
    """Sums over the days before each day, that day left out; missing days count as 0."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*key).orderBy(number)
    out = series
    for n in spans:
        out = out.withColumn(f"before_{n}", F.coalesce(F.sum(value).over(w.rangeBetween(-n, -1)), F.lit(0)))
    return out


def islands(rows: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """Runs of consecutive days of equal value: first and last day and length."""
    w = Window.partitionBy(*key).orderBy(day)
    new = F.when((F.datediff(day, F.lag(day).over(w)) == 1) & F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return (
        rows.withColumn("_new", new)
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy(*key, "_run", value)
        .agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days"))
        .drop("_run")
    )


def sightings(rows: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """First and last place of each key, number of rows, and first value that is not null."""
    return rows.groupBy(*key).agg(
        F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.count("*").alias("n"), F.min_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(order))).alias("first_value")
    )


def opened_and_settled(rows: DataFrame, key: str, at: str, day: str, opens: Column, settles: Column, as_of: Column, stale_days: int, keep: str = "first") -> DataFrame:
    """For each key with an opening row: when it opened, its settling row at or after that, and its state.

    ``at`` orders the rows of a key, ``day`` dates them.  ``keep`` chooses the
    first or the last settling row.  Unsettled keys are ``stale`` when they
    opened more than ``stale_days`` before ``as_of``, else ``pending``.  Two
    partial aggregates and a join on the key; no window.
    """
    opened = rows.where(opens).groupBy(key).agg(F.min(F.struct(F.col(at).alias("opened"), F.col(day).cast("date").alias("opened_day"))).alias("_o")).select(key, "_o.*")
    pick = F.min if keep == "first" else F.max
    settled = rows.where(settles).join(opened.select(key, "opened"), key).where(F.col(at) >= F.col("opened")).groupBy(key).agg(pick(at).alias("settled"))
    state = F.when(F.col("settled").isNotNull(), "settled").when(F.datediff(as_of, "opened_day") > stale_days, "stale").otherwise("pending")
    return opened.join(settled, key, "left").withColumn("state", state)


def log_interpolated(points: DataFrame, table: DataFrame, key: Sequence[str], x: str, y: str, at: str, to: str) -> DataFrame:
    """``to`` at ``at`` on the log-log line between bracketing table rows, held at the table's ends."""
    w = Window.partitionBy(*key).orderBy(x)
    segments = table.where((F.col(x) > 0) & (F.col(y) > 0)).select(*key, F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1"), F.row_number().over(w).alias("_r"))
    inside = (F.col(at) >= F.col("_x0")) | (F.col("_r") == 1)
    below_next = F.col("_x1").isNull() | (F.col(at) < F.col("_x1"))
    line = F.exp(F.ln("_y0") + (F.ln(at) - F.ln("_x0")) * (F.ln("_y1") - F.ln("_y0")) / (F.ln("_x1") - F.ln("_x0")))
    value = F.when((F.col(at) <= F.col("_x0")) | F.col("_x1").isNull(), F.col("_y0")).otherwise(line)
    return points.join(segments, list(key)).where(inside & below_next).withColumn(to, value).drop("_x0", "_y0", "_x1", "_y1", "_r")


def dense_months(rows: DataFrame, month: str, fill: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Every month between a key's first and last, ``fill`` columns 0 where there was no row; ``rows`` has one a key and month."""
    ends = rows.groupBy(*key).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    axis = ends.select(*key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias(month))
    return axis.join(rows, [*key, month], "left").select(*key, month, *(F.coalesce(c, F.lit(0)).alias(c) if c in fill else F.col(c) for c in rows.columns if c not in (*key, month)))


def sessions(rows: DataFrame, key: Sequence[str], at: str, gap: str) -> DataFrame:
    """Rows merged while each follows the one before within ``gap``: begin, end and count."""
    return rows.groupBy(*key, F.session_window(at, gap).alias("_s")).agg(F.min(at).alias("begin_ts"), F.max(at).alias("end_ts"), F.count("*").alias("n")).drop("_s")


def outliers(rows: DataFrame, group: Sequence[str], value: str, limit: float = 3.5) -> DataFrame:
    """High values by modified z-score: 0.6745 * (x - median) / MAD over ``limit`` and more than twice the median.

    Medians run over ranges of values, so a hot group is spread over tasks.
    """
    middle = percentiles(rows, group, value, {"median": 0.5}).drop("n")
    off = rows.join(middle, list(group)).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    spread = percentiles(off, group, "_d", {"mad": 0.5}).drop("n")
    score = 0.6745 * (F.col(value) - F.col("median")) / F.col("mad")
    return off.join(spread, list(group)).where((F.col("mad") > 0) & (score > limit) & (F.col(value) > 2 * F.col("median"))).drop("_d")
