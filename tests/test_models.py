"""The logistic model against plain Newton steps in numpy, and gated writes, dry runs and commented tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import aggregates, learning, sinks
from gaugeworks.operators.ranges import running
from gaugeworks.plans import registry
from gaugeworks.sources import readers

FOLDER = "/root/testdata/sf0.001"


def test_logistic_and_calibration_match_numpy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    rows = docs.merge(labels, on="doc_id")
    x = np.stack([np.log1p(rows.n_chars), (rows.text.str.len() % 97).astype(float)], axis=1)
    sd = x.std(axis=0)
    x = np.c_[np.ones(len(x)), (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)]
    y, w = rows.quality.to_numpy(dtype=float), np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(3), x.T @ (p - y) + 1e-6 * w)
    p = 1 / (1 + np.exp(-x @ w))
    bins = np.minimum(np.floor(p * 10), 9).astype(int)
    want = {int(b): ((bins == b).sum(), p[bins == b].mean(), y[bins == b].mean()) for b in np.unique(bins)}
    got = {r.bin: (r.n, r.predicted, r.observed) for r in registry.queries()["standardize_and_logistic"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[b], want[b], atol=1e-6) for b in want)


def test_unconverged_steps_are_an_error(spark):
    rows = spark.range(200).select((F.col("id") % 7).alias("x"), (F.col("id") % 2).alias("y"))
    with pytest.raises(ValueError, match="converge"):
        learning.logistic(rows, ["x"], "y", steps=1)


def test_running_totals_of_hot_groups(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 1009).alias("v"))
    by = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    table = {(r.g, r.v): r.c for r in by.collect()}
    for r in running(by, ["g"], "v", ["c"]).collect():
        assert r.c_upto == sum(c for (g, v), c in table.items() if g == r.g and v <= r.v)
    got = aggregates.percentiles(rows, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()
    for r in got:
        own = [v for (g, v), c in table.items() if g == r.g for _ in range(c)]
        assert np.allclose([r.p10, r.p50, r.p99], np.percentile(own, [10, 50, 99]))


def test_gated_write_and_dry_run(spark, tmp_path):
    rows = spark.range(5).withColumn("v", F.col("id") * 2)
    with pytest.raises(sinks.Refused):
        sinks.gated_write(rows, f"file://{tmp_path}/out", {"negative": lambda r: r.where("v >= 8").count()})
    assert not (tmp_path / "out").exists()
    sinks.gated_write(rows, f"file://{tmp_path}/out", {"negative": lambda r: r.where("v < 0").count()})
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5
    plan, after = sinks.planned(rows, F.col("id") == 3, F.lit(0), "v")
    assert [(r.id, r.old, r.new) for r in plan.collect()] == [(3, 6, 0)] and after.agg(F.sum("v")).first()[0] == 14


def test_tab_separated_with_a_row_of_formats(spark, tmp_path):
    (tmp_path / "a.rdb").write_text("# note\nsite\tlevel\n5s\t10n\n00012\t3.5\n00013\t\n")
    got = [tuple(r) for r in readers.rdb(spark, f"file://{tmp_path}/a.rdb", "site string, level string").orderBy("site").collect()]
    assert got == [("00012", "3.5"), ("00013", None)]


def test_importance_of_a_shuffled_column(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 2).alias("told"), F.lit(5).alias("flat"), F.lit(None).cast("double").alias("none"))
    got = learning.permutation_importance(rows, "id", ["told", "flat", "none"], "y", lambda told, flat, none: told + 0 * flat + none, repeats=3, bins=4).collect()
    assert len(got) == 9
    for r in got:  # half of all rows get the other label's value
        assert abs(r.harm - 0.5) < 0.1 if r.column == "told" else r.harm == 0
    assert learning.permutation_importance(rows.where("false"), "id", ["told"], "y", lambda x: x).count() == 0
