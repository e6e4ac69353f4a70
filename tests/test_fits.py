"""Models fitted together in scans against plain loops in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import fits


def design(rows, columns):
    return np.column_stack([np.ones(len(rows)), *([float(r[c] or 0) for r in rows] for c in columns)])


def newton(x, y, ridge=1e-6):
    w, damp = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (p - y) + damp @ w)
    return w


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        a, b = rng.normal(size=2)
        state = None if i % 10 == 0 else f"s{int(rng.integers(0, 6))}"
        if state is None or i % 7:
            rows.append({"i": i, "state": state, "year": 2000 + int(rng.integers(0, 7)), "a": float(a), "b": None if i % 50 == 3 else float(b), "y": int(rng.random() < 1 / (1 + np.exp(-a + 0.5 * b + 0.7))), "paid": float(np.exp(7 + a + rng.standard_t(2))) if rng.random() < 0.6 else 0.0})
    return rows, spark.createDataFrame(rows, "i long, state string, year int, a double, b double, y int, paid double").repartition(5)


def test_left_out_groups_are_refitted(data):
    rows, df = data
    got = {r.i: r.p for r in fits.left_out(df, ["a", "b"], "y", "state").collect()}
    for held in {r["state"] for r in rows if r["state"]}:
        train, test = [r for r in rows if r["state"] != held], [r for r in rows if r["state"] == held]
        w = newton(design(train, "ab"), np.array([r["y"] for r in train]))
        assert np.allclose([got[r["i"]] for r in test], 1 / (1 + np.exp(-design(test, "ab") @ w)), atol=1e-9)
    assert all(got[r["i"]] is None for r in rows if r["state"] is None) and len(got) == len(rows)


def test_forward_folds_begin_with_the_fourth_year(data):
    rows, df = data
    got = {r.i: r.p for r in fits.forward(df, ["a", "b"], "y", "year").collect()}
    for year in range(2000, 2007):
        train, test = [r for r in rows if r["year"] < year], [r for r in rows if r["year"] == year]
        if year < 2003:
            assert all(got[r["i"]] is None for r in test)
        else:
            w = newton(design(train, "ab"), np.array([r["y"] for r in train]))
            assert np.allclose([got[r["i"]] for r in test], 1 / (1 + np.exp(-design(test, "ab") @ w)), atol=1e-9)


def test_one_scan_a_step(data, monkeypatch):
    _, df = data
    scans = []
    frame = type(df)
    whole = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: (scans.append(1), whole(self, *a, **k))[1])
    fits.left_out(df, ["a", "b"], "y", "state")
    assert 3 <= len(scans) <= 12  # all six models together


def test_a_fold_without_two_classes_is_not_fitted(spark):
    df = spark.createDataFrame([(1, "a", 0.1, 1), (2, "a", 0.7, 1), (3, "b", 0.3, 0), (4, "b", 0.2, 0)], "i int, g string, x double, y int")
    assert [r.p for r in fits.left_out(df, ["x"], "y", "g").collect()] == [None] * 4
    assert fits.left_out(df.limit(0), ["x"], "y", "g").count() == 0
    with pytest.raises(ValueError, match="more than"):
        fits.left_out(spark.range(5000).select("id", F.lit(1.0).alias("x"), F.lit(1).alias("y")), ["x"], "y", "id")


def test_lines_of_folds(data):
    rows, df = data
    found = {(r.fold, r.held): r for r in fits.left_out_lines(df, "a", "y", "state", "year").collect()}
    assert {k for k in found if k[0] == "forward"} == {("forward", str(y)) for y in range(2003, 2007)}
    for (fold, held), r in found.items():
        train = [x for x in rows if (x["state"] != held and x["state"] if fold == "left out" else str(x["year"]) < held)]
        test = [x for x in rows if (x["state"] if fold == "left out" else str(x["year"])) == held]
        slope, intercept = np.polyfit([x["a"] for x in train], [x["y"] for x in train], 1)
        assert np.allclose([r.slope, r.intercept], [slope, intercept])
        assert r.n == len(test) and np.isclose(r.error, np.mean([(x["y"] - intercept - slope * x["a"]) ** 2 for x in test]))


def test_robust_costs(data, spark):
    rows, df = data
    few = [{**rows[0], "state": "tiny", "paid": 5.0}] * 19 + [{**rows[0], "state": "tiny", "paid": 0.0}] * 30
    found = {r.state: r for r in fits.robust_costs(df.unionByName(spark.createDataFrame(few, df.schema)), ["a", "b"], "paid", "state").collect()}
    assert found["tiny"].n == 19 and found["tiny"].weights is None and found["tiny"].r2 is None and found["tiny"].residual_sd is None
    for state in {r["state"] for r in rows if r["state"]}:
        paid = [r for r in rows if r["state"] == state and r["paid"] > 0]
        x, y = design(paid, "ab"), np.log1p([r["paid"] for r in paid])
        w = np.linalg.lstsq(x, y, rcond=None)[0]
        delta = np.quantile(np.abs(y - x @ w), 0.9, method="inverted_cdf")
        for _ in range(2000):
            u = np.minimum(1, delta / np.abs(y - x @ w))
            w = np.linalg.solve((x * u[:, None]).T @ x, (x * u[:, None]).T @ y)
        left = y - x @ w
        r = found[state]
        assert r.n == len(paid) and np.allclose(r.weights, w, atol=1e-5), (r.weights, w)
        assert np.isclose(r.r2, 1 - (left**2).sum() / ((y - y.mean()) ** 2).sum(), atol=1e-5) and np.isclose(r.residual_sd, left.std(), atol=1e-5)


def test_two_part_costs(data):
    rows, df = data
    got = {r.i: r for r in fits.hurdle_costs(df, ["a", "b"], "paid", "state").collect()}
    x, paid = design(rows, "ab"), np.array([r["paid"] for r in rows])
    # occurrence: the penalised score is zero, and the estimate differs from the plain one
    w, y = np.zeros(3), (paid > 0).astype(float)
    for _ in range(300):
        p = 1 / (1 + np.exp(-x @ w))
        info = (x * (p * (1 - p))[:, None]).T @ x
        h = p * (1 - p) * np.einsum("ni,ij,nj->n", x, np.linalg.inv(info), x)
        w = w + np.linalg.solve(info, x.T @ (y - p + h * (0.5 - p)))
    assert np.allclose([got[r["i"]].p for r in rows], 1 / (1 + np.exp(-x @ w)), atol=1e-6)
    assert not np.allclose(w, newton(x, y), atol=1e-5)
    # size
    have = paid > 0
    v = np.linalg.lstsq(x[have], np.log(paid[have]), rcond=None)[0]
    left = np.log(paid[have]) - x[have] @ v
    assert np.allclose([got[r["i"]].typical for r in rows], x @ v, atol=1e-6)
    # pooling
    states = np.array([r["state"] or "" for r in rows])[have]
    names = sorted(set(states) - {""})
    n = np.array([(states == s).sum() for s in names])
    mean = np.array([left[states == s].mean() for s in names])
    within = sum(((left[states == s] - left[states == s].mean()) ** 2).sum() for s in names) / (n.sum() - len(names))
    between = max(0.0, ((n * mean**2).sum() - (len(names) - 1) * within) / (n.sum() - (n**2).sum() / n.sum()))
    effect = dict(zip(names, n / (n + within / between) * mean if between else 0 * mean, strict=True))
    assert all(np.isclose(got[r["i"]].effect, effect.get(r["state"], 0.0), atol=1e-6) for r in rows)
    whole = [got[r["i"]].p * np.exp(got[r["i"]].typical + got[r["i"]].effect + (left**2).mean() / 2) for r in rows]
    assert np.allclose([got[r["i"]].expected for r in rows], whole)
    # one model of all amounts
    u = np.array([np.log(paid.mean()), 0, 0])
    for _ in range(500):
        m = np.exp(x @ u)
        u = u + np.linalg.solve((x * (m**0.5)[:, None]).T @ x, x.T @ ((paid - m) * m**-0.5))
    assert np.allclose([got[r["i"]].tweedie for r in rows], np.exp(x @ u), rtol=1e-5)


def test_firth_is_finite_where_classes_are_apart(spark):
    df = spark.createDataFrame([(float(i), int(i > 4)) for i in range(10)], "x double, y int")
    found = fits.fit(df, ["x"], "y", None, ["all"], fits.own, fits.firth)["all"]
    assert np.isfinite(found.weights).all() and 0.5 < found.weights[1] < 3


def test_pooling_leaves_nothing_of_equal_groups(spark):
    df = spark.createDataFrame([(g, float(v)) for g in "abc" for v in (-1, 1)] + [(None, 3.0), ("a", None)], "g string, v double")
    assert {(r.g, r.n, r.mean, r.effect) for r in fits.pooled_effects(df, "g", "v").collect()} == {(g, 2, 0.0, 0.0) for g in "abc"}
