"""The paged source over a small web service: conditions passed on, key sweeps, key lists, lost rows."""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import datasource
from pyspark.sql import functions as F

from gaugeworks.sources import paged

ROWS = [{"id": k, "name": f"n'{k % 3}", "v": None if k % 5 == 0 else k, "at": None if k % 11 == 0 else f"2020-0{1 + k % 3}-1{k % 4}T{k % 24:02d}:30:00.000z"} for k in range(230)]
_WORDS = {" eq null": " is None", " ne null": " is not None", " eq ": " == ", " ge ": " >= ", " gt ": " > ", " le ": " <= ", " lt ": " < "}


def _meets(words: str, row: dict) -> bool:
    for a, b in _WORDS.items():
        words = words.replace(a, b)
    words = re.sub(r"'((?:[^']|'')*)'", lambda m: repr(m[1].replace("''", "'")), words)
    try:
        return bool(eval(words, {}, dict(row)))
    except TypeError:  # a null compares with nothing
        return False


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append(q.get("$filter", ""))
            got = [r for r in ROWS if "$filter" not in q or _meets(q["$filter"], r)]
            skip, top = int(q.get("$skip", 0)), int(q["$top"])
            body = json.dumps({"metadata": {"count": len(got)}, "items": got[skip : skip + top]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/x", asked
    server.shutdown()


def _read(spark, url, **options):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").schema("id int, name string, v int").options(url=url, key="items", page="50", **options).load()


def test_conditions_are_passed_on(spark, service):
    url, asked = service
    got = _read(spark, url).where((F.col("id") >= 100) & (F.col("name") == "n'1") & F.col("v").isNotNull()).collect()
    assert sorted(r.id for r in got) == [r["id"] for r in ROWS if r["id"] >= 100 and r["name"] == "n'1" and r["v"] is not None]
    assert any("name eq 'n''1'" in a and "id ge 100" in a for a in asked)


def test_days_and_times_are_passed_on(spark, service):
    url, asked = service
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.PagedSource)
    for kind, tests in {
        "date": [("= '2020-02-11'", lambda x: x[:10] == "2020-02-11"), ("> '2020-02-11'", lambda x: x[:10] > "2020-02-11"), ("<= '2020-01-12'", lambda x: x[:10] <= "2020-01-12"), ("< '2020-01-12'", lambda x: x[:10] < "2020-01-12"), ("in ('2020-01-10', '2020-03-13')", lambda x: x[:10] in ("2020-01-10", "2020-03-13"))],
        "timestamp": [(">= timestamp '2020-02-11T05:30:00Z'", lambda x: x >= "2020-02-11T05:30:00.000z"), ("= timestamp '2020-01-10T12:30:00Z'", lambda x: x == "2020-01-10T12:30:00.000z")],
    }.items():
        rows = spark.read.format("paged").schema(f"id int, at {kind}").options(url=url, key="items", page="50").load()
        for words, meets in tests:
            asked.clear()
            got = rows.where(f"at {words}").collect()
            assert sorted(r.id for r in got) == [r["id"] for r in ROWS if r["at"] and meets(r["at"])], words
            assert any("at " in a and "2020-" in a for a in asked), words


def test_key_sweep_takes_all_rows_or_fails(spark, service):
    url, _ = service
    assert sorted(r.id for r in _read(spark, url, sweep="id,0,240,70").collect()) == list(range(230))
    with pytest.raises(Exception, match="30 rows lie outside"):
        _read(spark, url, sweep="id,0,200,70").collect()


def test_long_key_lists_are_partitions(spark, service):
    url, asked = service
    wanted = list(range(0, 300, 3))
    rows = _read(spark, url).where(F.col("id").isin(wanted))
    assert sorted(r.id for r in rows.collect()) == [k for k in wanted if k < 230]
    assert max(a.count(" eq ") for a in asked) == paged.LIST


def test_clauses():
    col = ("v",)
    assert paged.clause(datasource.Not(datasource.EqualTo(col, True))) == "not (v eq true)"
    assert paged.clause(datasource.In(col, ())) is None and paged.clause(datasource.EqualTo(col, 1.5)) is None
    assert paged.clause(datasource.IsNull(col)) == "v eq null" and paged.clause(datasource.StringContains(col, "x")) is None
