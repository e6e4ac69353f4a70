"""Work that must not grow faster than the tables: what meets what, how often a table is read, what one task holds."""

from __future__ import annotations

import datetime as dt

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import fits, joins, similarity
from gaugeworks.plans import catalog_state, panel, registry
from gaugeworks.sources import readers
from gaugeworks.streaming import inventory

D = dt.date
FOLDER = "/root/testdata/sf0.001"


def _plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def _panel(spark, n: int):
    return spark.range(n).select(
        F.lit("27001").alias("fips"), F.lit("27").alias("state"), F.col("id").alias("episode"), F.lit(D(2020, 1, 10)).alias("begin"), F.lit(D(2020, 1, 11)).alias("end"), F.lit(1).alias("damage"), F.lit(0).cast("long").alias("tornadoes"), F.lit(-1).alias("ef"), F.lit(0).alias("gust"),
        F.lit(0.0).alias("hail"), F.lit(False).alias("flood"), F.lit(True).alias("winter"), (F.col("id") % 3).alias("dn"),
    )


def test_episodes_of_one_span_are_looked_up_once(spark, monkeypatch):
    """lookups by dates grew with the episodes times the incidents or days of a county."""
    met = []

    def counted(f):
        def run(left, *rest, **more):
            met.append(left.count())
            return f(left, *rest, **more)

        return run

    monkeypatch.setattr(panel, "overlap_first_match", counted(joins.overlap_first_match))
    monkeypatch.setattr(panel, "window_values", counted(joins.window_values))
    incidents = spark.createDataFrame([("27001", 4, D(2020, 1, 1), D(2020, 1, 5), 2.0), ("27001", 6, D(2020, 1, 1), D(2020, 1, 5), 3.0)], "fips string, dn int, incident_begin date, incident_end date, cost double")
    daily = spark.createDataFrame([("27001", D(2020, 1, 9), 2.0, 3.0), ("27001", D(2020, 1, 10), 1.0, 4.0)], "fips string, day date, mean double, most double")
    out = panel.with_snow(panel.with_rain(panel.declared(_panel(spark, 50).drop("dn"), incidents), daily), daily.withColumnRenamed("mean", "depth"))
    rows = out.collect()
    assert len(rows) == 50 and {(r.dn, r.cost, r.rain_event, r.rain_before_7, r.snow_depth_before, r.snow_melt) for r in rows} == {(6, 3.0, 1.0, 2.0, 2.0, 1.0)}
    assert met == [1, 1, 1]


def test_state_panel_reads_the_panel_once(spark):
    """the panel was computed and dealt twice, for the measures and for the incident."""
    out = panel.state_panel(_panel(spark, 7))
    assert _plan(out).count("Range (0, 7") == 1
    assert [(r.counties, r.dn, r.n_winter if "n_winter" in out.columns else None) for r in out.where("episode = 4").collect()] == [(1, 1, None)]


def _differs(spark, folder, name: str, **rows: str) -> str | None:
    """What a query and its SQL disagree about, on the smallest tables with some of them replaced by the SQL of ``rows``."""
    small = compare.connect(FOLDER)
    for table, sql in rows.items():
        small.sql(f"copy ({sql}) to '{folder}/{table}.parquet'")
    for table in ("part", "supplier", "nation", "orders", "customer", "lineitem", "events"):
        if table not in rows:
            small.sql(f"copy (select * from {table}) to '{folder}/{table}.parquet'")
    return compare.difference(spark, compare.connect(str(folder)), registry.queries()[name], registry.oracle_sql()[name], str(folder))


def test_shares_are_summed_before_they_meet_members(spark):
    """every supplier met every customer of its nation."""
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 7.0)], "zone string, x double")
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 3)], "zone string, member int")
    many = joins.expand_and_split(rows, members, "zone", "x", "member").groupBy("member").agg(F.count("*").alias("n"), F.sum(F.round("x", 6)).alias("total"))
    assert {tuple(r) for r in joins.split_totals(rows, members, "zone", "x", "member").collect()} == {tuple(r) for r in many.collect()}
    assert _plan(registry.queries()["crosswalk_expand_split"](spark, FOLDER)).count("sum(") >= 2


@pytest.mark.parametrize("price", [575.0, 4145.0, 8075.0, 12345.0])
def test_money_is_rounded_as_in_its_sql(spark, tmp_path, price):
    """4145 in thousands is 4.145, whose double hundredfold lies below the half."""
    assert _differs(spark, tmp_path, "money_text", orders=f"select * replace ({price}::double as o_totalprice) from orders") is None


def test_parts_and_sources_of_one_number_are_two(spark, tmp_path):
    """part 1000050 passed for the source 1000050 that there is none of; a supplier without a nation lost its script."""
    parts = "select * from part union all select * exclude (k) replace (k as p_partkey) from part, range(1000050, 1000075) r(k) where p_partkey = 9"
    suppliers = "select * from supplier union all select * exclude (k) replace (k as s_suppkey, case when k = 900 then 99 else s_nationkey end as s_nationkey) from supplier, range(900, 960, 9) r(k) where s_suppkey = 9"
    assert _differs(spark, tmp_path, "lineage_problems", part=parts, supplier=suppliers) is None


def test_no_error_is_too_small_for_a_case(spark):
    """only errors of 80 and purchases of 120 were followed."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    found = registry.queries()["appeal_state_machine"](spark, FOLDER).where("size = 'any'")
    assert found.count() == events.where("event_type = 'error'").select("user_id").distinct().count()


def test_a_planned_change_is_shown_for_every_line(spark):
    """F8: only the counts were returned."""
    assert registry.queries()["planned_change"](spark, FOLDER).where("l_orderkey is not null").count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


def test_a_search_by_grams_broadcasts_no_table(spark):
    """exploded grams passed for as small as the file of names, and were broadcast by way of the driver."""
    assert "BroadcastExchange" not in registry.queries()["listing_then_detail"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_a_row_meets_its_own_model_only(spark):
    """every row was worked through for the models of all groups."""
    def loss(eta, y, leverage, which):
        assert eta.ndim == 1 and len(which) == len(eta)
        return fits.squares(eta, y, leverage, which)

    rows = spark.createDataFrame([(g, float(x), g * 10.0 + 2 * x) for g in (1, 2) for x in range(9)] + [(None, 1.0, 1.0)], "g int, x double, y double")
    found = fits.fit(rows, ["x"], "y", "g", [1, 2, 3], fits.own, loss)
    assert {g: f.rows for g, f in found.items()} == {1: 9, 2: 9, 3: 0} and abs(found[2].weights[0] - 20) < 1e-4


def test_revisions_land_in_files_of_bounded_size(spark, monkeypatch):
    """a quarter of the table was one file and one task's."""
    monkeypatch.setattr(catalog_state, "FILE_ROWS", 500)
    assert compare.difference(spark, compare.connect(FOLDER), registry.queries()["revised_totals"], registry.oracle_sql()["revised_totals"], FOLDER) is None


def test_metrics_are_counted_before_they_are_joined(spark):
    """all rows of a metric were dealt to one task."""
    assert "LeftSemi" in _plan(registry.queries()["separation_study"](spark, FOLDER))


def test_counties_of_a_day_are_not_searched_one_by_one(spark):
    """F16: each county's peak was looked for through the day's whole map."""
    days = spark.createDataFrame([('[["2020-01-01",{"a":1.5,"b":null,"c":2.0},{"c":3.0,"d":9.0,"b":4.0}]]',), ('[["2020-01-02",{"a":1.0},null]]',)], "document string")
    out = readers.gridded_days(days)
    assert "element_at" not in _plan(out)
    assert {tuple(r)[0] + str(r.day.day): (r.mean, r.most) for r in out.collect()} == {"a1": (1.5, None), "b1": (None, 4.0), "c1": (2.0, 3.0), "a2": (1.0, None)}


def test_costs_are_joined_once_for_all_models(spark):
    """customers, orders and their scales were computed again for every model."""
    assert "o_custkey" not in _plan(registry.queries()["two_part_costs"](spark, FOLDER))


def test_analogs_meet_in_tiles_with_ties_as_in_their_sql(spark, tmp_path):
    """every pair of a row and a query was an expression over arrays of its own."""
    rows = "select * exclude (k) replace (vec_id + 100000 * k as vec_id) from embeddings, range(3) r(k) where vec_id < 150 order by vec_id desc"
    assert _differs(spark, tmp_path, "knn_gaussian_analogs", embeddings=rows) is None
    assert "zip_with" not in _plan(registry.queries()["knn_gaussian_analogs"](spark, str(tmp_path)))


def test_lists_of_a_place_are_dealt_to_queries_not_pairs(spark, tmp_path, monkeypatch):
    """every pair of a query and a member of its places was a row, shuffled before it was counted."""
    monkeypatch.setattr(similarity, "LISTED", 3)
    keys = "case when o_orderkey % 50 = 0 then null when o_orderkey % 3 = 0 then 100 * (o_custkey % 7) else o_custkey end"
    assert _differs(spark, tmp_path, "footprint_analogs", orders=f"select * replace ({keys} as o_custkey) from orders", lineitem="select * replace (nullif(l_suppkey, 5) as l_suppkey) from lineitem") is None
    plan = _plan(registry.queries()["footprint_analogs"](spark, str(tmp_path)))
    assert "members" in plan and "shared" not in plan.split("FlatMapGroupsInArrow", 1)[1].split("\n", 1)[1]


def test_shared_members_are_counted_in_portions(monkeypatch):
    """counts of portions add up, the query itself is left out, ties go to the smaller member."""
    lists = [np.array(x) for x in ([1, 2, 9], [2, 3, 9], [], [3, 4, 9], [5])]
    for most in (1, 4, 100):
        monkeypatch.setattr(similarity, "GATHERED", most)
        assert [x.tolist() for x in similarity._most_shared(9, iter(lists), 3)] == [[2, 3, 1], [2, 2, 1]]
    assert [x.tolist() for x in similarity._most_shared(9, iter([np.array([9])]), 3)] == [[], []]


class _Handle:
    """State of one request in a test; counts the messages that it costs."""

    def __init__(self):
        self.value, self.timers, self.messages = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages, self.value = self.messages + 1, value

    def registerTimer(self, at):
        self.messages += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.messages += 1
        self.timers.remove(at)


def test_a_request_costs_few_messages_to_its_state():
    """each field and timer of a request was asked for, looked up and written by messages of its own, over a dozen a request."""
    handle, requests = _Handle(), inventory.Requests(["k"], ["period", "decision"], 4)
    requests.init(handle)
    rows = [("a", 5_000, 9_000, 3, 9_000, 2, "late", None, None, None, None), ("a", 4_000, 4_000, 4, 4_000, 1, "early", 4_000, 1, "yes", None)]
    (new,) = requests.handleInputRows(("a",), iter(rows), None)
    assert handle.messages == 3 and handle.timers == {9 + 4 * inventory.DAY_MS}
    assert new.asDict() == {"k": "a", "first": 4_000, "last": 9_000, "flags": 7, "period": "early", "decision": "yes", "period_at": 4_000, "decision_at": 4_000, "changes": 1, "status": "open"}
    list(requests.handleInputRows(("a",), iter([("a", 20_000, 20_000, 8, None, None, None, None, None, None, None)]), None))
    assert handle.messages == 7 and handle.timers == {20 + 4 * inventory.DAY_MS}
    handle.timers.clear()  # Spark removes what has expired
    (closed,) = requests.handleExpiredTimer(("a",), None, None)
    (again,) = requests.handleInputRows(("a",), iter([("a", 30_000, 30_000, 0, 3_000, 9, "first", None, None, None, None)]), None)
    assert (closed.status, closed.changes, closed.flags, again.status, again.period, again.decision, again.first) == ("closed", 3, 15, "open", "first", "yes", 4_000)


@pytest.mark.parametrize("held", [2, 7, 1_000])
def test_sightings_of_a_request_are_put_together_first(spark, monkeypatch, held):
    """every sighting was a row of Python before it met its request."""
    monkeypatch.setattr(inventory, "HELD", held)
    rows = [(None if i % 5 == 0 else i % 3, "xyz"[i % 2], *(2 * [i * 7919 % 50]), 1 << i % 4, *((None, None, None) if i % 4 else (i * 7919 % 50, i % 6, f"p{i}"))) for i in range(60)]
    rows.append((9, "x", None, None, 0, None, None, None))
    given = spark.createDataFrame(rows, "a int, b string, first long, last long, flags long, at0 long, id0 long, value0 string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = [tuple(r) for r in inventory.together(given, ["a", "b"], 1).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def plain(rows):
        out = {}
        for r in rows:
            out.setdefault(r[:2], []).append(r[2:])
        known = lambda x, best: best((v for v in x if v is not None), default=None)
        flags = lambda x: int(np.bitwise_or.reduce(list(x)))
        return {k: (known((r[0] for r in v), min), known((r[1] for r in v), max), flags(r[2] for r in v), min((r[3:] for r in v if r[3] is not None), default=(None, None, None))) for k, v in out.items()}

    assert plain(got) == plain(rows)
    assert len(got) < len(rows) and (held < 1_000 or len(got) == len(plain(rows)))
