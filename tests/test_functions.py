"""Column expressions on the awkward inputs that they are for."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import classify, names, parsing
from gaugeworks.operators import aggregates, buckets, graph, joins, learning, linkage, windows


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(column).collect()]


def test_money(spark):
    rows = [("2.50K",), ("10.00M",), ("1.2B",), ("",), ("junk",), (None,), ("750",), ("k",)]
    assert values(spark, "x string", rows, parsing.money(F.col("x"))) == [2500.0, 1e7, 1.2e9, 0, 0, 0, 750, 0]


def test_codes(spark):
    assert values(spark, "x string", [("7",), ("1234",), (None,)], parsing.pad_code(F.col("x"), 3)) == ["007", "1234", None]
    assert values(spark, "s string, c string", [("7", "1"), ("27", "000"), ("27", ""), ("27", None)], parsing.county_code(F.col("s"), F.col("c"))) == ["07001", None, None, None]


def test_scales_and_years(spark):
    rows = [("EF3",), ("F2",), ("EFU",), (None,)]
    assert values(spark, "x string", rows, parsing.tornado_scale(F.col("x"))) == [3, 2, None, None]
    assert values(spark, "x string", rows, parsing.tornado_scale(F.col("x"), True)) == [3, None, None, None]
    years = [("2014-05",), ("1899",), ("FY 2011 plan",), ("1985",)]
    assert values(spark, "x string", years, parsing.year_prefix(F.col("x"))) == [2014, None, None, None]
    assert values(spark, "x string", years, parsing.year_anywhere(F.col("x"))) == [2014, None, 2011, 1985]
    assert values(spark, "x string", years, parsing.year_number(F.col("x"))) == [None, None, None, 1985]


def test_inferred_year(spark):
    seen = dt.date(2024, 3, 1)
    got = values(spark, "m int, d int, s date", [(10, 24, seen), (2, 29, seen), (3, 5, seen), (2, 30, seen)], parsing.infer_year(F.col("m"), F.col("d"), F.col("s")))
    assert got == [dt.date(2023, 10, 24), dt.date(2024, 2, 29), dt.date(2023, 3, 5), None]
    assert values(spark, "m int, d int, s date", [(3, 5, seen)], parsing.infer_year(F.col("m"), F.col("d"), F.col("s"), 10)) == [dt.date(2024, 3, 5)]


def test_classes(spark):
    rows = [(True, 5, 10.0), (True, 5, 0.0), (True, 0, None), (True, None, 0.0), (False, 3, 0.0), (False, 0, 0.0)]
    got = values(spark, "p boolean, n int, a double", rows, classify.assistance_state(F.col("p"), F.col("n"), F.col("a")))
    assert got == ["IHP_WITH_AWARDS", "IHP_NO_AWARDS", "IA_ONLY", "IA_ONLY", "IA_ONLY_ANOMALY", "NONE"]
    assert values(spark, "x double", [(None,), (-1.0,), (0.0,), (9.9,), (10.0,), (99.0,)], classify.band(F.col("x"), [0, 10])) == [None, None, 0, 0, 1, 1]
    assert values(spark, "x double", [(None,)], classify.band(F.col("x"), [0, 10], True)) == [0]


def test_names(spark):
    assert values(spark, "x string", [("St. Mary's (County)",), ("Fond-du Lac County",)], names.county_key(F.col("x"))) == ["stmarys", "fonddulac"]
    got = values(spark, "x string", [("Forest Park",), ("Park Forest",), ("Dept. of of Health",)], names.normalized(F.col("x")))
    assert got == ["forest park", "park forest", "department of health"]
    assert values(spark, "x string", [("The Floods of Glass",)], names.stems(F.col("x"))) == [["flood", "glas"]]


@pytest.mark.parametrize(("gap", "dn"), [(10, 7), (11, None)])
def test_interval_edge_after(spark, gap, dn):
    end = dt.date(2020, 5, 5)
    left = spark.createDataFrame([("a", 1, dt.date(2020, 5, 1), end)], "fips string, ep int, b date, e date")
    right = spark.createDataFrame([("a", 7, end + dt.timedelta(gap), end + dt.timedelta(90))], "fips string, dn int, ib date, ie date")
    spans = (F.date_sub("b", 4), F.date_add("e", 10)), (F.col("ib"), F.col("ie"))
    out = joins.overlap_first_match(left, right, ["fips"], ["fips", "ep"], *spans, F.col("dn"), ["dn"])
    assert out.first().dn == dn


def test_nearest_takes_the_first_of_equals(spark):
    a = spark.createDataFrame([(1, "s", dt.date(2020, 1, 10))], "i int, st string, d date")
    b = spark.createDataFrame([(8, "s", dt.date(2020, 1, 12)), (5, "s", dt.date(2020, 1, 8))], "o int, st string, e date")
    assert joins.nearest(a, b, ["st"], "i", "d", "e", 10, ["o"], "o").first().o == 5


def test_a_missing_day_breaks_the_pair(spark):
    rows = [("a", dt.date(2020, 1, 1), 9.0), ("a", dt.date(2020, 1, 3), 1.0), ("b", dt.date(2020, 1, 1), 9.0), ("b", dt.date(2020, 1, 2), 4.0)]
    out = windows.largest_adjacent_drop(spark.createDataFrame(rows, "s string, d date, v double"), ["s"], "d", "v")
    assert {r.s: r["drop"] for r in out.collect()} == {"a": 0.0, "b": 5.0}


def test_auc_ties_count_half_and_null_is_zero(spark):
    rows = spark.createDataFrame([(1.0, 1), (1.0, 0), (None, 0), (2.0, 1)], "x double, y int")
    assert aggregates.rank_auc(rows, "x", "y").first().auc == pytest.approx((0.5 + 1 + 1 + 1) / 4)
    assert aggregates.rank_auc(rows.where("y = 1"), "x", "y").first().auc is None


def test_buckets_lose_nothing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0), (None, 8.0), ("a", -0.5)], "k string, v double")
    places = spark.createDataFrame([("a", True), ("b", False)], "k string, declared boolean")
    out = buckets.conservation(buckets.bucketed(rows, places, ["k"], F.col("k").isNull(), "declared"), [], "bucket", "v")
    assert {r.bucket: (r.n, r.amount, r.total_amount) for r in out.collect()} == {"in_county": (2, 0.5, 14.5), "undeclared": (1, 2.0, 14.5), "unmatched": (1, 4.0, 14.5), "statewide": (1, 8.0, 14.5)}


def test_required_rows_fail_loudly(spark):
    rows = spark.range(3)
    assert buckets.require(rows, (F.col("id") < 5, "small")).count() == 3
    with pytest.raises(Exception, match="too large"):
        buckets.require(rows, (F.col("id") < 2, "too large")).collect()


def test_cone_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    out = graph.cone(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r.node: r.depth for r in out.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_logistic_finds_the_sign(spark):
    rows = spark.createDataFrame([(float(k), float(k % 3), int(k + 7 * (k % 3 == 1) > 50)) for k in range(100)], "a double, b double, y int")
    w = learning.logistic(rows, ["a", "b"], "y", ridge=1e-2)
    assert w is not None and w[1] > 0
    assert learning.logistic(rows.where("y = 0"), ["a", "b"], "y") is None
    assert learning.shifted_intercept(0.0, 0.5, 0.5) == 0.0


def test_overrides_come_before_groups(spark):
    rows = spark.createDataFrame([("x", "ACME", 1.0), ("y", "Acme Co", 2.0), ("z", "Other", 1.0)], "k string, name string, v double")
    forced = spark.createDataFrame([("ACME", "y")], "name string, target string")
    out = {r.k: (r.variants, r.amount, r.display) for r in linkage.merged(rows, "k", "name", "v", forced).collect()}
    assert out == {"y": (2, 3.0, "Acme Co"), "z": (1, 1.0, "Other")}
