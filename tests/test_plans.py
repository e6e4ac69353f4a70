"""The panel on handmade storms, and streams against their batch results."""

from __future__ import annotations

import datetime as dt
import gzip

from pyspark.sql import functions as F

from gaugeworks.plans import panel
from gaugeworks.sources import paged, readers
from gaugeworks.streaming import state, windows

D = dt.date


def test_panel(spark, tmp_path):
    head = ",".join(reversed(readers.STORM_COLUMNS))
    rows = [
        ("27", "C", "1", "AITKIN", "Tornado", "5", "201005", "3", "0", "", "EF2", "2.5M"),
        ("27", "C", "1", "AITKIN", "Thunderstorm Wind", "5", "201005", "4", "60", "EG", "", "1K"),
        ("27", "Z", "7", "NORTH", "Flood", "5", "201005", "4", "", "", "", "10K"),
        ("27", "Z", "7", "NORTH", "Hail", "5", "201005", "4", "2", "", "", "10K"),
        ("55", "C", "9", "DANE", "Hail", "6", "201006", "1", "1.75", "", "", ""),
    ]
    text = "\n".join([head, *(",".join(reversed(r)) for r in rows)])
    (tmp_path / "d.csv.gz").write_bytes(gzip.compress(text.encode("latin-1")))
    (tmp_path / "z.txt").write_text("\n".join(f"MN|007|DLH|N|27007|C|{f}|C|x|1|2" for f in ("27001", "27003", "2700")).replace("MN|", "27|"))
    storms = readers.storm_events(spark, str(tmp_path / "d.csv.gz"), ["27"])
    counties = panel.county_rows(storms, readers.zone_counties(spark, str(tmp_path / "z.txt")))
    episodes = panel.episodes(counties)
    got = {r.fips: r for r in episodes.collect()}
    assert set(got) == {"27001", "27003"}
    a = got["27001"]
    assert (a.begin, a.end, a.gust, a.ef, a.tornadoes, a.damage, a.flood, a.zoned) == (D(2010, 5, 3), D(2010, 5, 4), 69, 2, 1, 2506000, True, True)
    incidents = spark.createDataFrame([("27001", 9, D(2010, 5, 8), D(2010, 6, 1), 5.0), ("27001", 8, D(2010, 5, 1), D(2010, 5, 9), 7.0), ("27003", 9, D(2010, 5, 9), D(2010, 6, 1), 5.0)], "fips string, dn int, incident_begin date, incident_end date, cost double")
    labelled = panel.declared(episodes, incidents)
    assert {r.fips: (r.declared, r.dn) for r in labelled.collect()} == {"27001": (1, 9), "27003": (0, None)}
    # an episode may begin ten days after an incident's end and end four days before its begin
    edges = spark.createDataFrame([("27001", 5, D(2010, 4, 1), D(2010, 4, 23), 1.0), ("27003", 5, D(2010, 4, 1), D(2010, 4, 23), 1.0)], incidents.schema)
    assert {r.fips: r.declared for r in panel.declared(episodes, edges).collect()} == {"27001": 1, "27003": 0}
    rain = spark.createDataFrame([("27001", D(2010, 5, d), 0.5, 1.0 * d) for d in (1, 3, 4, 5)] + [("27001", D(2010, 4, 22), 2.0, 9.0)], "fips string, day date, mean double, most double")
    wet = {r.fips: r for r in panel.with_rain(labelled, rain).collect()}
    assert (wet["27001"].rain_day_max, wet["27001"].rain_event, wet["27001"].rain_before_7, wet["27001"].rain_before_14) == (4.0, 1.0, 0.5, 2.5)
    assert wet["27003"].rain_event is None
    states = panel.state_panel(labelled).collect()
    assert [(r.state, r.counties, r.counties_over, r.dn, r.incident, r.season) for r in states] == [("27", 2, 2, 9, "Flood", "spring")]


def test_snow_is_null_where_unobserved_and_zero_in_summer(spark):
    p = spark.createDataFrame([("a", 1, D(2020, 1, 10), D(2020, 1, 12)), ("b", 1, D(2020, 1, 10), D(2020, 1, 12)), ("a", 2, D(2020, 7, 1), D(2020, 7, 2))], "fips string, episode int, begin date, end date")
    depth = spark.createDataFrame([("a", D(2020, 1, d), x) for d, x in ((5, 20.0), (8, 12.0), (9, 10.0), (10, 3.0), (12, 0.0))], "fips string, day date, depth double")
    got = {(r.fips, r.episode): (r.snow_depth_before, r.snow_melt, r.water_melt) for r in panel.with_snow(p, depth).collect()}
    assert got == {("a", 1): (20.0, 7.0, 2.1), ("b", 1): (None, None, None), ("a", 2): (0.0, 0.0, 0.0)}


def test_station_arrays_and_nested_readings(spark):
    rows = spark.createDataFrame([("a", "2020-01-30", [["1.5", "M", "T"], ["2.0A", "", "3"]])], "fips string, sdate string, stations array<array<string>>")
    got = [(r.station, str(r.day), r.value) for r in readers.station_days(rows).orderBy("station", "day").collect()]
    assert got == [(0, "2020-01-30", 1.5), (0, "2020-01-31", None), (0, "2020-02-01", 0.0), (1, "2020-01-30", 2.0), (1, "2020-01-31", None), (1, "2020-02-01", 3.0)]
    doc = '{"value":{"timeSeries":[{"sourceInfo":{"siteCode":[{"value":"7"}]},"values":[{"value":[{"value":"12.5","dateTime":"2020-01-01T00:00:00"},{"value":"-999999","dateTime":"2020-01-02T00:00:00"},{"value":"900","dateTime":"2020-01-03T00:00:00"}]}]}]}}'
    assert [(r.site, str(r.day), r.value) for r in readers.gauge_series(spark.createDataFrame([(doc,)], "document string")).collect()] == [("7", "2020-01-01", 12.5)]
    table = spark.createDataFrame([('[["NAME","POP"],["x","5"]]',)], "document string")
    assert [(r.row, r.column, r.value) for r in readers.header_array(table).orderBy("column").collect()] == [(1, "NAME", "x"), (1, "POP", "5")]


def test_paged_source_covers_and_checks_its_rows(monkeypatch):
    from pyspark.sql.types import StructType

    rows = [{"id": k, "v": str(k)} for k in range(25)]

    def service(url, **_):
        query = dict(x.split("=") for x in url.replace("%24", "$").split("?")[1].split("&"))
        skip, top = int(query.get("$skip", 0)), int(query["$top"])
        return {"metadata": {"count": 25}, "items": rows[skip : skip + top]}

    monkeypatch.setattr(paged, "fetch", service)
    reader = paged.PagedReader(StructType.fromDDL("id int, v string"), {"url": "http://x", "key": "items", "page": "10"})
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(k, str(k)) for k in range(25)]
    rows.pop()
    try:
        list(reader.read(reader.partitions()[-1]))
    except ValueError as e:
        assert "short pull" in str(e)
    else:
        raise AssertionError("a short pull must fail")


def _events(spark, tmp_path, parts=3):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).repartitionByRange(parts, "ts").write.parquet(str(tmp_path / "in"))
    return events, windows.event_stream(spark, str(tmp_path / "in"), events.schema, 1)


def test_streamed_windows_match_the_batch(spark, tmp_path):
    events, stream = _events(spark, tmp_path)
    windows.tumbling(stream, "6 hours", "40 days", "event_type").writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("tumbled").select("window", "event_type", "n").exceptAll(want).isEmpty() and spark.table("tumbled").count() == want.count()


def test_streamed_cases_match_the_batch(spark, tmp_path):
    events, _ = _events(spark, tmp_path)
    # a last event of another user moves the watermark past all others
    last = events.limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "event_type": F.lit("view"), "ts": F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz")})
    last.write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), events.schema, 1)
    for days in (60, 2):
        name = f"cases_{days}"
        state.cases(stream, "error", "purchase", "40 days", days).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        ts = F.col("ts").cast("timestamp")
        opened = events.where("event_type = 'error'").groupBy("user_id").agg(F.min(ts).alias("opened"))
        settles = events.where("event_type = 'purchase'").select("user_id", ts.alias("settled"))
        in_time = (F.col("settled") > F.col("opened")) & (F.col("settled") <= F.col("opened") + F.make_interval(days=F.lit(days)))
        want = opened.join(settles, "user_id", "left").groupBy("user_id", "opened").agg(F.min(F.when(in_time, F.col("settled"))).alias("settled"))
        got = {(r.user_id, r.opened, r.settled, r.state) for r in spark.table(name).collect()}
        assert got == {(r.user_id, r.opened, r.settled, "settled" if r.settled else "stale") for r in want.collect()}
        assert len(got) > 5
