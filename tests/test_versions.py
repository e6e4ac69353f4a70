"""Versions, revisions and requests: readers and totals after failures, replays and restarts."""

from __future__ import annotations

import random
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sinks
from gaugeworks.sources import scratch
from gaugeworks.sources.versions import Conflict, Versions, rewritten
from gaugeworks.streaming import inventory, revisions


def held(rows):
    return sorted(map(tuple, rows.collect()))


def test_a_failure_before_publishing_leaves_the_old_version(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t")
    assert table.version() is None and table.read() is None
    first = rewritten(table, lambda old: spark.createDataFrame([(1, None), (2, "x")], "k int, v string"))
    pinned = table.read(first)

    def stamp(old):
        return sinks.stamped(old, spark.createDataFrame([(1, "new"), (2, None)], "k int, v string"), ["k"], ["v"])

    staged = table.stage(stamp(table.read()))  # the writer ends here
    assert held(table.read()) == [(1, None), (2, "x")] and table.version() == first
    rewritten(table, stamp)
    assert held(table.read()) == [(1, "new"), (2, "x")] and held(pinned) == [(1, None), (2, "x")]
    assert staged in table.clean() and held(pinned) == [(1, None), (2, "x")]
    rewritten(table, lambda old: old.where("k = 1"))
    gone = table.clean()
    assert first.parts["rows"] in gone and table.numbers() == [2, 3] and held(table.read(table.version(2))) == [(1, "new"), (2, "x")]


def test_a_failed_task_publishes_nothing(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t")
    rewritten(table, lambda old: spark.range(3))
    with pytest.raises(Exception, match="(?i)divi"):
        rewritten(table, lambda old: old.withColumn("id", F.expr("cast(1 div (id - 2) as long)")))
    assert held(table.read()) == [(0,), (1,), (2,)] and table.numbers() == [1]
    assert len(table.clean()) == 1


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t")
    base = rewritten(table, lambda old: spark.range(1))
    a, b = table.stage(spark.range(2)), table.stage(spark.range(3))
    table.publish({"rows": a}, base, {"by": "a"})
    with pytest.raises(Conflict):
        table.publish({"rows": b}, base, {"by": "b"})
    assert held(table.read()) == [(0,), (1,)] and table.version().note == {"by": "a"}
    assert not [p for p in Path(tmp_path, "t", "_versions").iterdir() if p.name.startswith("draft")]


def statements(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(40)]), rng.choice("abc"), Decimal(rng.randint(-500, 5000)) / 100, i if rng.random() < 0.9 else i - 30, f"2024-{rng.randint(1, 12):02d}-01") for i in range(n)]


_KIND = "key long, grp string, amount decimal(18,2), stated long, day string"


def recomputed(rows):
    best, day = {}, {}
    for key, grp, amount, stated, d in rows:
        if key is not None:
            best[key] = max(best.get(key, (-99, "", Decimal(0))), (stated, grp, amount))
            day[key] = max(day.get(key, ""), d)
    totals = {}
    for _, grp, amount in best.values():
        n, t = totals.get(grp, (0, Decimal(0)))
        totals[grp] = n + 1, t + amount
    return {(k, b[1], b[2], b[0], day[k]) for k, b in best.items()}, {(g, n, t) for g, (n, t) in totals.items()}


def test_totals_equal_a_full_recomputation(spark, tmp_path, monkeypatch):
    table = Versions(spark, f"file://{tmp_path}/t")
    rows = statements(400, 3)
    batches = [rows[:150], rows[150:160], [], rows[160:390], rows[390:]]
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, _KIND)
        if number == 3:  # the writer fails when all is written but not published
            with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
                m.setattr(Versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                revisions.revise(table, df, number, 4)
        assert revisions.revise(table, df, number, 4)
        assert not revisions.revise(table, df, number, 4)  # played again
        kept, totals = recomputed([r for b in batches[: number + 1] for r in b])
        assert {tuple(r) for r in revisions.ledger(table).collect()} == kept
        assert {tuple(r)[:3] for r in revisions.rollup(table).collect()} == totals
    assert len(list(Path(tmp_path, "t", "data").iterdir())) < 20 and table.numbers() == [4, 5]
    with pytest.raises(ValueError, match="buckets"):
        revisions.revise(table, df, 9, 8)


def test_amounts_go_down_and_newest_days_stay(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t")
    for number, row in enumerate([(1, "a", 100, 5, "2024-05-01"), (1, "a", 40, 6, "2024-04-01"), (1, "a", 999, 2, "2024-06-01"), (1, "b", 10, 7, "2024-01-01")]):
        revisions.revise(table, spark.createDataFrame([row], "key int, grp string, amount int, stated int, day string"), number, 2)
        got = held(revisions.rollup(table))
        assert got == [[("a", 1, Decimal(100), "2024-05-01")], [("a", 1, Decimal(40), "2024-05-01")], [("a", 1, Decimal(40), "2024-06-01")], [("b", 1, Decimal(10), "2024-06-01")]][number]


def test_a_stream_of_statements_is_resumed(spark, tmp_path):
    rows = statements(90, 8)
    table = Versions(spark, f"file://{tmp_path}/t")
    for part in range(3):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], _KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(_KIND).parquet(f"{tmp_path}/in")
        revisions.keep_revised(stream, table, f"{tmp_path}/checkpoint", 4)
        assert {tuple(r)[:3] for r in revisions.rollup(table).collect()} == recomputed(rows[: 30 * part + 30])[1]


_SEEN = "state string, kind string, ts timestamp, id long, flags int, period string, decision string"


def sighted(spark, n=300):
    rng = random.Random(n)
    base = spark.range(n).select("id", (F.col("id") * 7919 % 60).alias("day"))
    rows = [(rng.choice(["MN", "WI", None]), rng.choice("xyz"), r.day, r.id, rng.choice([0, 1, 2, 4, None]), rng.choice([None, "", f"p{r.id}"]), f"d{r.id}" if rng.random() < 0.05 else None) for r in base.collect()]
    # one request is not seen for the last weeks, another comes back after a gap
    rows = [r for r in rows if not (r[1] == "x" and r[2] > 20) and not (r[1] == "y" and 10 < r[2] < 50)]
    df = spark.createDataFrame(rows, "state string, kind string, day int, id long, flags int, period string, decision string")
    return df.select("state", "kind", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days="day", secs=F.col("id") % 1000)).alias("ts"), "id", "flags", "period", "decision")


def plain_inventory(rows):
    micros = lambda t: round(t.timestamp() * 1_000_000)
    out = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.id)):
        e = out.setdefault((r.state, r.kind), {"first": micros(r.ts), "flags": 0, "period": None, "decision": None, "decision_at": None})
        e["last"] = micros(r.ts)
        e["flags"] |= r.flags or 0
        e["period"] = e["period"] or r.period or None
        if r.decision and not e["decision"]:
            e["decision"], e["decision_at"] = r.decision, micros(r.ts)
    return out


def test_two_runs_with_a_restart_equal_one(spark, tmp_path):
    seen = sighted(spark)
    expected = plain_inventory(seen.collect())
    keys, fields = ["state", "kind"], ["period", "decision"]

    def run(name, parts):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            stream = spark.readStream.schema(_SEEN).parquet(f"{tmp_path}/{name}/in")  # a new query each time, from the same checkpoint
            inventory.collect_available(inventory.requests(stream, keys, "ts", "id", "flags", fields, "100 days"), f"{tmp_path}/{name}/checkpoint", f"{tmp_path}/{name}/rows")
        found = inventory.current(spark, f"{tmp_path}/{name}/rows", keys)
        return {tuple(r[k] for k in keys): r for r in found.collect()}

    whole = run("one", [seen])
    halves = run("two", [seen.where("id % 3 = 0"), seen.where("id % 3 > 0")])
    for got in (whole, halves):
        assert {k: {c: r[c] for c in ("first", "flags", "period", "decision", "decision_at", "last")} for k, r in got.items()} == expected


def test_requests_are_closed_by_a_timer_and_opened_again(spark, tmp_path):
    seen = sighted(spark)
    keys = ["state", "kind"]
    states = []
    for until in (45, 60):
        seen.where(f"ts < timestamp '2024-01-01' + interval {until} days and ts >= timestamp '2024-01-01' + interval {0 if until == 45 else 45} days").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(_SEEN).parquet(f"{tmp_path}/in")
        inventory.collect_available(inventory.requests(stream, keys, "ts", "id", "flags", ["period"], "1 day"), f"{tmp_path}/c", f"{tmp_path}/rows")
        states.append({r.kind: r.status for r in inventory.current(spark, f"{tmp_path}/rows", keys).collect()})
    assert states[0] == {"x": "closed", "y": "closed", "z": "open"} and states[1] == {"x": "closed", "y": "open", "z": "open"}


def test_scratch_tables_lie_in_the_shared_folder(spark):
    rows = scratch.written(spark.range(5), "five")
    assert rows.count() == 5 and scratch.root(spark).removeprefix("file://") in rows.inputFiles()[0]
    before = spark.sparkContext.getCheckpointDir()
    scratch.written(rows)
    assert spark.sparkContext.getCheckpointDir() == before
