"""Names, entities, audits, lineage, scopes and analogs on small cases."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import names, parsing
from gaugeworks.operators import aggregates, buckets, graph, linkage, similarity, sinks, windows

KEYS = {
    "City of Ames": "city of ames",
    "AMES, CITY OF": "city of ames",
    "Ames (City of) (2)": "city of ames",
    "DO NOT USE - ames city": "city of ames",
    "(do not use)Ames Township": "township of ames",
    "Ames Twp": "township of ames",
    "Ames / Hwy Dept. / HWY DEPT": "ames highway department",
    "rural co op & svcs": "rural cooperative services",
    "Utility Utility Dist": "utility utility district",
    "a b c a b c": "a b c",
    "north north": "north",
    "City": "city",
    "City of": "city of",
    "Town of Lake Village": "village of town of lake",
    "O'Hara \"Util\" Assoc": "o hara utility association",
    "old duplicate entry (13)": "old entry",
    "": "",
}


def test_applicant_keys(spark):
    rows = spark.createDataFrame([(k,) for k in KEYS] + [(None,)], "n string")
    got = {r.n: r.k for r in rows.select("n", names.applicant_key(F.col("n")).alias("k")).collect()}
    assert got == {**KEYS, None: None}
    assert [r[0] for r in rows.where("lower(n) like '%not use%'").select(names.retired(F.col("n"))).collect()] == [True, True]


def test_display_names_prefer_what_is_in_use(spark):
    rows = [("k", "DO NOT USE Ames City", 900.0)] * 5 + [("k", "AMES CITY", 50.0)] * 3 + [("k", "Ames City", 1.0), ("k", "Ames City!", 1.0)] + [("j", "B b", 1.0), ("j", "A a", 1.0)]
    out = {r.k: (r.variants, r.n, r.display) for r in linkage.merged(spark.createDataFrame(rows, "k string, name string, v double"), "k", "name", "v").collect()}
    assert out == {"k": (4, 10, "Ames City"), "j": (2, 2, "A a")}


def test_entities(spark):
    states = F.create_map(*map(F.lit, ("MN", "5", "WI", "5", "ND", "8")))
    notes = F.create_map(*map(F.lit, ("1", "Lower Oak Nation of the Plains", "2", "Lake Band, Wi", "3", "Spirit People", "4", "Oak Nation, MN")))
    tribes = F.create_map(*map(F.lit, ("oak nation", "ND", "spirit", "XX")))
    raws = ["MN", " wi2 ", "M", "MNX1", "Oak1", "Oak 4", "B2", "S3", "T9", "T", "12", None]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, r string")
    got = {raws[r.i]: tuple(r.e) for r in rows.select("i", names.resolved_entity(F.col("r"), notes, states, tribes).alias("e")).collect()}
    assert got["MN"] == ("state", "MN", None, "MN", "5") and got[" wi2 "] == ("state", "WI", None, "WI", "5")
    assert got["M"] == ("tribal", "M", None, None, None) and got["MNX1"][:2] == ("tribal", "MNX")
    assert got["Oak1"] == ("tribal", "Oak", "Lower Oak Nation of the Plains", "ND", "8") and got["Oak 4"] == ("tribal", "Oak", "Oak Nation, MN", "ND", "8")
    assert got["B2"] == ("tribal", "B", "Lake Band, Wi", "WI", "5")
    assert got["S3"] == ("tribal", "S", "Spirit People", "XX", None)
    assert got["T9"] == ("tribal", "T", None, None, None) == got["T"] and got["12"] == ("tribal", "", None, None, None)


def test_a_column_is_grounded_as_a_whole_name(spark):
    cases = {("x['pop']", "pop"): True, ("df.POP + 1", "pop"): True, ("df[pop]", "pop"): True, ("pop", "pop"): False, ("'population'", "pop"): False, ("'a.b'", "a.b"): True, ("'axb'", "a.b"): False, ('"n(x)"', "n(x)"): True, ("'pop_2'", "pop"): False}
    rows = spark.createDataFrame([(t, n) for t, n in cases], "t string, n string")
    assert {(r.t, r.n): r.g for r in rows.select("t", "n", parsing.grounded(F.col("t"), F.col("n")).alias("g")).collect()} == cases


def test_audits_tell_the_worst(spark):
    rows = spark.createDataFrame([(1, 100.0, 100.0), (2, 100.0, 104.9), (3, 10_000.0, 10_049.0), (4, 10_000.0, 10_051.0), (5, 1.0, 90.0), (6, None, 5.0)], "k int, total double, parts double")
    total, parts = F.col("total").cast("decimal(18,2)"), F.col("parts").cast("decimal(18,2)")
    got = [tuple(r) for r in buckets.audit(rows, "k", {"sum": (total, parts, F.abs(total - parts) > buckets.tolerance(total)), "over": (total, parts, F.when(total > 99, parts > total + 9999))}).collect()]
    assert got == [("sum", 5, 2, -193.9, 5, 89.0), ("over", 4, 0, -104.9, None, None)]
    assert [tuple(r) for r in buckets.audit(rows.limit(0), "k", {"sum": (total, parts, total > parts)}).collect()] == [("sum", 0, 0, None, None, None)]


def test_conservation_within_tolerance(spark):
    rows = spark.createDataFrame([(5000, 3000, 2900, 100), (5001, 3000, 3000, 0), (500_000, 495_000, 495_000, 0), (500_000, 494_999, 494_990, 8)], "e long, f long, k long, a long")
    got = [tuple(r[0]) for r in rows.select(buckets.conserved(*map(F.col, "efka"))).collect()]
    assert got == [(True, True), (True, False), (True, True), (False, False)]


def test_plans_are_what_happens(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, v string")
    plan, after = sinks.planned(rows, F.col("i") == 2, F.lit("b"), "v")
    assert [(r.old, r.new) for r in plan.collect()] == [("a", "b")] and sorted(r.v for r in after.collect()) == ["a", "b", "b"]


def test_scopes_hold_where_all_rows_have_a_place(spark):
    rows = spark.createDataFrame([("n", "x", 1), ("n", "y", 2), ("s", "z", 4), ("s", None, 8), (None, None, 16)], "region string, state string, v int").withColumn("v", F.col("v").cast("decimal(18,2)"))
    got = {(r.scope, r.region, r.state): (r.n, int(r.amount), r.holds) for r in aggregates.scopes(rows, ["region", "state"], ["all", "region", "state"], "v").collect()}
    assert got == {
        ("all", None, None): (5, 31, False), ("region", "n", None): (2, 3, True), ("region", "s", None): (2, 12, False),
        ("state", "n", "x"): (1, 1, True), ("state", "n", "y"): (1, 2, True), ("state", "s", "z"): (1, 4, True),
    }


def test_months_of_each_key(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 2), ("a", "2024-03-01", 1), ("b", "2024-06-01", 5)], "k string, m string, n int").withColumn("m", F.col("m").cast("date"))
    assert sorted((r.k, str(r.m), r.n) for r in windows.dense_months(rows, "m", ["n"], ["k"]).collect()) == [("a", "2024-01-01", 2), ("a", "2024-02-01", 0), ("a", "2024-03-01", 1), ("b", "2024-06-01", 5)]


def test_lineage_problems(spark):
    def df(kind, *rows):
        return spark.createDataFrame(list(rows), kind)

    found = graph.lineage_problems(
        df("id string, file string, producer string, retired boolean", ("a", "a.json", "t", False), ("b", "b.json", None, False), ("c", "c.json", None, True), ("d", "d.json", "t", None)),
        df("file string", ("a.json",), ("b.json",), ("c.json",), ("e.json",)),
        df("id string, script string", ("t", "t.py"), ("u", "u.py")),
        df("script string, text string", ("t.py", "write('a.json') read('Rivers')")),
        df("transform string, id string", ("t", "a"), ("t", "d"), ("t", "zz"), ("u", "a")),
        df("transform string, id string", ("t", "r"), ("t", "s"), ("t", "a"), ("u", "q")),
        df("id string, name string, dictionary string", ("r", "Rivers", "dict"), ("s", "Snow", "gone"), ("w", "W", None)),
        df("source string, column string", ("r", "Stage"), ("r", "flow"), ("s", "x"), ("w", "y")),
        df("dictionary string, column string", ("dict", "stage"), ("dict", "STAGE")),
    )
    assert {tuple(r) for r in found.collect()} == {
        ("orphan file", "e.json", "e.json"), ("missing file", "d", "d.json"), ("no producer", "b", "b.json"), ("missing script", "u", "u.py"), ("unknown write", "t", "zz"), ("unknown read", "u", "q"),
        ("write not in script", "t", "d.json"), ("read not in script", "t", "Snow"), ("column not in dictionary", "r", "flow"), ("missing dictionary", "s", "gone"),
    }


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_analogs_in_one_scan(spark, monkeypatch, broadcast):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "BROADCAST", broadcast)
    rng = random.Random(5)
    rows = [(i, [rng.random(), rng.random()], rng.choice(["a", "b", None])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>, kind string").repartition(3)
    got = {}
    out = similarity.analogs(df, df.where("id < 10"), "id", "v", "kind", keep=4)
    assert "Union" not in out._jdf.queryExecution().toString()  # no branch for each block
    for r in out.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["weight"]))
    for i, v, kind in rows[:10]:
        weights = [(round(math.exp(-math.dist(v, w) ** 2 / 2) + 0.1 * (kind == k), 9), j) for j, w, k in rows if j != i]
        best = sorted(weights, key=lambda x: (-x[0], x[1]))[:4]
        assert [(n, round(x, 8)) for _, n, x in sorted(got[i])] == [(j, round(w, 8)) for w, j in best]
    assert similarity.analogs(df, df.where("id < 0"), "id", "v", "kind").count() == 0


def test_intervals_are_weighted_quantiles(spark):
    near = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.3), (1, 12, 0.2), (1, 13, 9.0), (1, 14, 9.0), (2, 10, 0.0), (3, 10, 1.0)], "query int, neighbour int, weight double")
    facts = spark.createDataFrame([(10, Decimal(100), 10), (11, Decimal(20), 10), (12, Decimal(900), 10), (13, None, 10), (14, Decimal(5), 0), (1, None, 50), (2, None, 5)], "k int, paid decimal(10,2), people int")
    got = [tuple(round(x, 9) for x in r) for r in similarity.suggested(near, facts, facts, "k", "k", "paid", "people").collect()]
    assert got == [(1, 3, 100.0, 500.0, 4500.0, round(50 * (0.5 * 10 + 0.3 * 2 + 0.2 * 90), 9))]
