"""Logistic models and their checks; every pass over the data is one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.aggregates import standardized


def _score(columns: Sequence[str], weights: np.ndarray) -> Column:
    z = F.lit(float(weights[0]))
    for c, w in zip(columns, weights[1:], strict=True):
        z = z + F.col(c) * float(w)
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def logistic(rows: DataFrame, columns: Sequence[str], label: str, steps: int = 100, ridge: float = 1e-6, least_positives: int = 20) -> np.ndarray | None:
    """Intercept and weights on standardized columns by Newton steps; None with too few positives, an error if they do not converge.

    Each step aggregates the gradient and the (small) Hessian on the executors;
    only those sums reach the driver.
    """
    data = standardized(rows.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns), F.col(label).cast("double").alias("_y")), columns).cache()
    if data.where("_y = 1").count() < least_positives:
        data.unpersist()
        return None
    k = len(columns) + 1
    w = np.zeros(k)
    xs = [F.lit(1.0), *map(F.col, columns)]
    for _ in range(steps):
        p = _score(columns, w)
        d = p * (1 - p)
        sums = [F.sum((p - F.col("_y")) * x) for x in xs] + [F.sum(d * xs[i] * xs[j]) for i in range(k) for j in range(i, k)]
        got = np.array(data.agg(*sums).first(), dtype=float)
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = got[k:]
        hessian = hessian + np.triu(hessian, 1).T + ridge * np.eye(k)
        change = np.linalg.solve(hessian, got[:k] + ridge * w)
        w -= change
        if np.abs(change).max() < 1e-9:
            data.unpersist()
            return w
    data.unpersist()
    raise ValueError(f"the weights did not converge in {steps} steps")


def scored(rows: DataFrame, columns: Sequence[str], weights: np.ndarray) -> DataFrame:
    """Rows with the probability ``p`` of a model fitted on the same rows' standardized columns."""
    clean = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return standardized(clean, columns).withColumn("p", _score(columns, weights))


def calibration(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Bins of predicted probability: rows, mean prediction and observed rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def permutation_importance(rows: DataFrame, key: str, columns: Sequence[str], label: str, score: Callable[..., Column], repeats: int = 8, bins: int = 64) -> DataFrame:
    """(column, repeat, harm): how much the Brier score of ``score(*columns)`` grows when one column is shuffled.

    In each repeat rows are dealt by a hash of their key to ``bins`` and passed on
    by one place in the order of that hash, the last to the first, so a window
    holds a bin and not the table: choose ``bins`` by the rows.  One window serves
    all columns.  Keys are expected to be unique; rows without key or label are
    left out, missing values count as 0, and a bin of one row keeps its value.
    """
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    clean = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("double").alias("_y"), F.struct(*values).alias("_v"))
    dealt = clean.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    dealt = dealt.withColumn("_h", F.md5(F.concat_ws(":", F.col("_k").cast("string"), F.col("repeat").cast("string"))))
    bin_ = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % bins
    order = Window.partitionBy("repeat", bin_).orderBy("_h", "_k")
    given = dealt.select("repeat", "_y", "_v", F.coalesce(F.lead("_v").over(order), F.first("_v").over(order)).alias("_g"))

    def missed(changed: str | None) -> Column:
        p = score(*(F.col("_g" if c == changed else "_v")[c] for c in columns))
        return (p - F.col("_y")) * (p - F.col("_y"))

    harms = given.groupBy("repeat").agg(*(F.avg(missed(c) - missed(None)).alias(c) for c in columns))
    return harms.unpivot(["repeat"], list(columns), "column", "harm")


def shifted_intercept(w0: float, sample_rate: float, population_rate: float) -> float:
    """Intercept corrected for a sample that holds more positives than the population."""
    return w0 - float(np.log((1 - population_rate) / population_rate * sample_rate / (1 - sample_rate)))
