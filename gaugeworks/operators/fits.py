"""Many small regression models at once: refitted folds, robust and two-part cost models.

``fit`` runs scoring steps for all models together.  A step is one scan: tasks
add up each model's slope and curvature in numpy over Arrow batches, Spark sums
what the tasks found, and the driver solves a system of a few unknowns for each
model.  Which rows a model learns from is a rule on a row's key, so folds that
leave one group out, or that learn from earlier years only, need no copies of
the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Models of one fit at most; more groups than that are an error, not dropped.
MODELS = 2000
#: (linear predictor, y, leverage x'Cx with C the inverse of the last curvature, numbers of the models) -> (slope, curvature) of the loss in the predictor.
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Member = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Fit(NamedTuple):
    rows: int
    total: float
    weights: np.ndarray | None  # intercept first; None where the model was refused


def own(models: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A model learns from the rows of its own key."""
    return keys[:, None] == models[None, :]


def others(models: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A model learns from all rows of other keys and from those without one."""
    return keys[:, None] != models[None, :]


def earlier(models: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A model learns from rows of smaller keys."""
    return np.array([[k is not None and k < m for m in models] for k in keys], dtype=bool).reshape(len(keys), len(models))


def squares(eta, y, leverage, which):
    return eta - y, np.ones_like(eta)


def huber(delta: Sequence[float]) -> Loss:
    """Squares up to ``delta``, a number a model, straight beyond; by reweighting."""
    bound = np.asarray(delta, dtype=float)

    def loss(eta, y, leverage, which):
        weight = np.minimum(1.0, bound[which] / np.maximum(np.abs(eta - y), 1e-300))
        return weight * (eta - y), weight

    return loss


def logistic(eta, y, leverage, which):
    p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
    return p - y, p * (1 - p)


def firth(eta, y, leverage, which):
    """Logistic with the penalised score that keeps estimates finite and takes off their first-order bias."""
    p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
    return p - y - p * (1 - p) * leverage * (0.5 - p), p * (1 - p)


def tweedie(power: float = 1.5) -> Loss:
    """Amounts with many zeros: variance mean ** ``power``, logarithmic link, expected curvature."""

    def loss(eta, y, leverage, which):
        mean = np.exp(np.clip(eta, -60, 60))
        return -(y - mean) * mean ** (1 - power), mean ** (2 - power)

    return loss


def fit(
    rows: DataFrame,
    columns: Sequence[str],
    y: str,
    key: str | None,
    models: Sequence,
    member: Member,
    loss: Loss,
    start: Callable[[float], float] = lambda mean: 0.0,
    fits: Callable[[int, float], bool] = lambda n, total: n > 0,
    ridge: float = 1e-6,
    steps: int = 200,
) -> dict[object, Fit]:
    """The weights of every model over ``rows`` (columns and y numeric, null counts as 0; rows with a null y are left out).

    ``start`` gives the first intercept from the mean of y, ``fits`` tells from
    the number of rows and the sum of y whether a model is fitted at all.  All
    models have to settle within ``steps``, else an error is raised.
    """
    if len(models) > MODELS:
        raise ValueError(f"{len(models)} models, more than {MODELS}")
    names = np.array(list(models), dtype=object)
    k, p = len(names), len(columns) + 1
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    data = rows.where(F.col(y).isNotNull()).select(*values, F.col(y).cast("double").alias("_y"), (F.col(key) if key else F.lit(None).cast("int")).alias("_k")).persist()

    alone = bool(key) and member is own or not key and k == 1

    def scan(weights: np.ndarray, inverse: np.ndarray, first: bool) -> np.ndarray:
        def of_own_models(batch: pa.RecordBatch, sums: np.ndarray) -> None:
            """A row teaches one model at most, so it is met by that one alone."""
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(p - 1))])
            target = batch.column(p - 1).to_numpy(zero_copy_only=False)
            at = np.zeros(len(x), dtype=int)
            if key:
                at = pc.fill_null(pc.index_in(batch.column(p), value_set=pa.array(list(models), batch.column(p).type)), -1).to_numpy(zero_copy_only=False).astype(int)
                x, target, at = x[at >= 0], target[at >= 0], at[at >= 0]
            parts = [np.ones(len(x)), target]
            if not first:
                leverage = np.einsum("ni,nij,nj->n", x, inverse[at], x)
                slope, curve = loss((x * weights[at]).sum(1), target, leverage, at)
                parts += [slope * x[:, i] for i in range(p)] + [curve * x[:, i] * x[:, j] for i in range(p) for j in range(p)]
            for i, part in enumerate(parts):
                sums[:, i] += np.bincount(at, weights=part, minlength=k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k, 2 + p + p * p))
            for batch in batches:
                if alone:
                    of_own_models(batch, sums)
                    continue
                x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(p - 1))])
                target = batch.column(p - 1).to_numpy(zero_copy_only=False)[:, None]
                inside = member(names, np.array(batch.column(p).to_pylist(), dtype=object)).astype(float) if key else np.ones((len(x), k))
                sums[:, 0] += inside.sum(0)
                sums[:, 1] += (inside * target).sum(0)
                if not first:
                    leverage = np.einsum("ni,kij,nj->nk", x, inverse, x)
                    slope, curve = loss(x @ weights.T, target, leverage, np.arange(k))
                    sums[:, 2 : 2 + p] += (inside * slope).T @ x
                    sums[:, 2 + p :] += np.einsum("nk,ni,nj->kij", inside * curve, x, x).reshape(k, -1)
            at = np.indices(sums.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums.ravel())], ["m", "i", "v"])

        out = np.zeros((k, 2 + p + p * p))
        for r in data.mapInArrow(run, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect():
            out[r.m, r.i] = r.v
        return out

    weights, inverse = np.zeros((k, p)), np.zeros((k, p, p))
    known = scan(weights, inverse, True)
    n, total = known[:, 0].astype(int), known[:, 1]
    alive = np.array([bool(fits(int(a), float(b))) for a, b in zip(n, total, strict=True)], dtype=bool)
    weights[:, 0] = [start(b / a) if ok else 0.0 for a, b, ok in zip(n, total, alive, strict=True)]
    moving = alive.copy()
    damp = ridge * np.diag([0.0] + [1.0] * (p - 1))
    last, pace = np.zeros((k, p)), np.ones(k)
    for step in range(steps):
        if not moving.any():
            break
        got = scan(weights, inverse, False)
        for m in np.flatnonzero(moving):
            curve = got[m, 2 + p :].reshape(p, p) + damp
            change = np.linalg.solve(curve, got[m, 2 : 2 + p] + damp @ weights[m])
            if step > 12 and change @ last[m] < 0:  # to and fro
                pace[m] *= 0.7
            last[m] = change
            change = change * pace[m] * min(1.0, 4.0 / max(np.abs(change).max(), 1e-300))  # no leaps from a poor start
            settled = np.abs(change).max() < 1e-9 * max(1.0, np.abs(weights[m]).max())
            weights[m] -= change
            inverse[m] = np.linalg.inv(curve)
            moving[m] = not settled
    data.unpersist()
    if moving.any():
        raise ValueError(f"{moving.sum()} models did not settle in {steps} steps")
    return {name: Fit(int(n[i]), float(total[i]), weights[i] if alive[i] else None) for i, name in enumerate(names)}


def predicted(rows: DataFrame, columns: Sequence[str], key: str, models: dict[object, Fit], to: str) -> DataFrame:
    """``rows`` with ``to``, the linear predictor of the model of their key; null without one."""
    known = [(m, [float(w) for w in f.weights]) for m, f in models.items() if f.weights is not None]
    kind = rows.schema[key].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(known, f"_m {kind}, _w array<double>")  # ``MODELS`` rows at most
    joined = rows.join(F.broadcast(table), F.col(key) == F.col("_m"), "left")
    eta = F.col("_w")[0]
    for i, c in enumerate(columns):
        eta = eta + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("_w")[i + 1]
    return joined.withColumn(to, eta).drop("_m", "_w")


def _keys(rows: DataFrame, key: str) -> list:
    found = [r[0] for r in rows.select(key).where(F.col(key).isNotNull()).distinct().limit(MODELS + 1).collect()]
    if len(found) > MODELS:
        raise ValueError(f"more than {MODELS} values of {key}")
    return sorted(found)


def _probability(eta: str) -> Column:
    return 1 / (1 + F.exp(-F.col(eta)))


def _two_classes(n: int, total: float) -> bool:
    return 0 < total < n


def left_out(rows: DataFrame, columns: Sequence[str], label: str, group: str) -> DataFrame:
    """``rows`` with ``p``: the probability from a logistic model that has not seen the row's group.

    Rows without a group teach every model and get no ``p``, nor do groups
    without which all labels are equal.  Columns are taken as they are: bring
    them to one scale before.
    """
    models = fit(rows, columns, label, group, _keys(rows, group), others, logistic, fits=_two_classes)
    return predicted(rows, columns, group, models, "_eta").withColumn("p", _probability("_eta")).drop("_eta")


def forward(rows: DataFrame, columns: Sequence[str], label: str, period: str, first: int = 3) -> DataFrame:
    """``rows`` with ``p`` from a model of all earlier periods; null in the ``first`` periods."""
    models = fit(rows, columns, label, period, _keys(rows, period)[first:], earlier, logistic, fits=_two_classes)
    return predicted(rows, columns, period, models, "_eta").withColumn("p", _probability("_eta")).drop("_eta")


def robust_costs(rows: DataFrame, columns: Sequence[str], amount: str, group: str, least: int = 20, share: float = 0.9) -> DataFrame:
    """(group, n, weights, r2, residual_sd) of a Huber regression of log(1 + amount) over each group's positive amounts.

    Groups of fewer than ``least`` such rows are refused: their weights, r2 and
    residual_sd are null.  The loss turns straight beyond the ``share`` quantile
    of the group's absolute residuals from least squares.
    """
    paid = rows.where(F.col(amount) > 0).withColumn("_log", F.log1p(F.col(amount).cast("double")))
    groups, fits = _keys(rows, group), lambda n, total: n >= least
    plain = fit(paid, columns, "_log", group, groups, own, squares, fits=fits)
    far = predicted(paid, columns, group, plain, "_eta").where("_eta is not null").groupBy(group).agg(F.percentile_approx(F.abs(F.col("_log") - F.col("_eta")), share, 10_000).alias("d"))
    delta = {r[0]: r[1] for r in far.collect()}
    models = fit(paid, columns, "_log", group, groups, own, huber([delta.get(g, 1.0) for g in groups]), start=lambda mean: mean, fits=fits)
    eta = predicted(paid, columns, group, models, "_eta")
    left = F.col("_log") - F.col("_eta")
    spread = eta.groupBy(group).agg(F.count("*").alias("n"), F.sum(left * left).alias("_s"), F.var_pop("_log").alias("_v"), F.stddev_pop(left).alias("residual_sd"))
    table = rows.sparkSession.createDataFrame([(g, [float(w) for w in f.weights] if f.weights is not None else None) for g, f in models.items()], f"{group} {rows.schema[group].dataType.simpleString()}, weights array<double>")
    r2 = F.when(F.col("_v") > 0, 1 - F.col("_s") / (F.col("n") * F.col("_v")))
    return table.join(spread, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"), "weights", F.when(F.col("weights").isNotNull(), r2).alias("r2"), F.when(F.col("weights").isNotNull(), F.col("residual_sd")).alias("residual_sd"))


def pooled_effects(rows: DataFrame, group: str, residual: str) -> DataFrame:
    """(group, n, mean, effect): each group's mean residual, shrunk towards zero by how little the group tells.

    ``effect = n / (n + s2 / t2) * mean`` with s2 the variance within groups and
    t2 that between them by moments (0 at least), all from one row of sums a
    group; rows with a null group or residual are left out.
    """
    sums = rows.where(F.col(group).isNotNull() & F.col(residual).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(residual).alias("mean"), F.var_pop(residual).alias("_v"))
    every = sums.agg(F.count("*").alias("_g"), F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("n")).alias("_nn"), F.sum(F.col("n") * F.col("_v")).alias("_w"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_b"))
    s2 = F.when(F.col("_n") > F.col("_g"), F.col("_w") / (F.col("_n") - F.col("_g"))).otherwise(F.lit(0.0))
    room = F.col("_n") - F.col("_nn") / F.col("_n")
    t2 = F.when(room > 0, F.greatest((F.col("_b") - (F.col("_g") - 1) * s2) / room, F.lit(0.0))).otherwise(F.lit(0.0))
    kept = F.when(t2 > 0, F.col("n") / (F.col("n") + s2 / t2)).otherwise(F.lit(0.0))
    return sums.join(F.broadcast(every)).select(group, "n", "mean", (kept * F.col("mean")).alias("effect"))  # one row


def hurdle_costs(rows: DataFrame, columns: Sequence[str], amount: str, group: str, power: float = 1.5) -> DataFrame:
    """``rows`` with p, typical, effect, expected and tweedie: what each row is expected to cost.

    ``p``: that there is any amount, by a logistic model with Firth's penalised
    score; ``typical``: the logarithm of positive amounts by least squares, plus
    ``effect``, the group's shrunk residual; ``expected``: both parts together,
    exp(typical + effect + s2 / 2) * p; ``tweedie``: the mean by one Tweedie model
    of all amounts.  Null amounts count as 0, negative ones as 0 too.
    """
    every = F.lit("all")
    given = rows.withColumn("_y", F.greatest(F.coalesce(F.col(amount).cast("double"), F.lit(0.0)), F.lit(0.0))).withColumn("_any", (F.col("_y") > 0).cast("double")).withColumn("_m", every)
    one = ["all"]
    occurs = fit(given, columns, "_any", None, one, own, firth)
    paid = given.where("_y > 0").withColumn("_log", F.log("_y"))
    size = fit(paid, columns, "_log", None, one, own, squares)
    mean = fit(given, columns, "_y", None, one, own, tweedie(power), start=lambda m: float(np.log(max(m, 1e-12))), fits=lambda n, total: total > 0)
    out = given.withColumnRenamed("_m", "_one")
    for models, name in ((occurs, "_o"), (size, "typical"), (mean, "_t")):
        out = predicted(out, columns, "_one", models, name)
    out = out.withColumn("_left", F.when(F.col("_y") > 0, F.log("_y") - F.col("typical")))
    effects = pooled_effects(out, group, "_left").select(F.col(group).alias("_g"), "effect")
    s2 = out.agg(F.avg(F.col("_left") * F.col("_left")).alias("_s2"))
    joined = out.join(effects, F.col(group) == F.col("_g"), "left").join(F.broadcast(s2)).withColumn("effect", F.coalesce("effect", F.lit(0.0))).withColumn("p", _probability("_o"))
    expected = F.col("p") * F.exp(F.col("typical") + F.col("effect") + F.col("_s2") / 2)
    return joined.withColumns({"expected": F.coalesce(expected, F.lit(0.0)), "tweedie": F.coalesce(F.exp("_t"), F.lit(0.0))}).drop("_y", "_any", "_one", "_o", "_t", "_left", "_g", "_s2")


def left_out_lines(rows: DataFrame, x: str, y: str, group: str, period: str, first: int = 3) -> DataFrame:
    """(fold, held, slope, intercept, n, error): straight lines fitted without a group, and on earlier periods only.

    Least squares is one step, so a group's line follows from the sums of all rows
    less its own, and a period's from running sums over the periods before it;
    ``error`` is the mean square of the held-out rows against their line.
    """
    cell = rows.where(f"{x} is not null and {y} is not null").select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(group).cast("string").alias("left out"), F.col(period).cast("string").alias("forward"))
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    parts = [F.count("*"), F.sum("x"), F.sum("y"), F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))]
    found = []
    for fold, frame in (("left out", Window.partitionBy("fold")), ("forward", Window.partitionBy("fold").orderBy("held").rowsBetween(Window.unboundedPreceding, -1))):
        own_sums = cell.where(F.col(fold).isNotNull()).groupBy(F.col(fold).alias("held")).agg(*(f.alias(a) for f, a in zip(parts, names, strict=True))).withColumn("fold", F.lit(fold))
        learnt = [(F.sum(a).over(frame) - (F.col(a) if fold == "left out" else F.lit(0))).alias(f"t{a}") for a in names]
        place = F.row_number().over(Window.partitionBy("fold").orderBy("held")) if fold == "forward" else F.lit(first + 1)
        found.append(own_sums.select("fold", "held", *names, *learnt, place.alias("place")).where(F.col("place") > first))  # one row a fold
    every = found[0].unionByName(found[1])
    room = F.col("tn") * F.col("tsxx") - F.col("tsx") * F.col("tsx")
    lines = every.withColumn("slope", F.when(room > 0, (F.col("tn") * F.col("tsxy") - F.col("tsx") * F.col("tsy")) / room)).withColumn("intercept", (F.col("tsy") - F.col("slope") * F.col("tsx")) / F.col("tn"))
    a, b = F.col("intercept"), F.col("slope")
    squared = F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + F.col("n") * a * a + 2 * a * b * F.col("sx") + b * b * F.col("sxx")
    return lines.select("fold", "held", "slope", "intercept", "n", (squared / F.col("n")).alias("error"))

