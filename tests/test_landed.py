"""Landed documents, shapes and printed dates: nulls, blanks, broken text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gaugeworks.functions import geometry, parsing
from gaugeworks.sources import readers


def test_printed_dates(spark):
    seen = dt.date(2024, 3, 1)
    texts = ["Nov 24", "July 3", "Aug 3, 2025", "Feb 29", "Feb 30", "Foo 3", "Aug 41, 2023", "", None, "mar 1"]
    rows = spark.createDataFrame([(k, t, seen) for k, t in enumerate(texts)], "k int, t string, s date")
    got = [r.d for r in rows.select("k", parsing.printed_date(F.col("t"), F.col("s")).alias("d")).orderBy("k").collect()]
    assert got == [dt.date(2023, 11, 24), dt.date(2023, 7, 3), dt.date(2025, 8, 3), dt.date(2024, 2, 29), None, None, None, None, None, dt.date(2024, 3, 1)]


def test_polygon_rings_and_centroids(spark):
    square = "[[0,0],[0,0],[0,2],[2,2],[2,0]]"
    texts = [f'{{"type":"Polygon","coordinates":[{square},[[1,1],[1,1],[1,1]]]}}', f'{{"type":"MultiPolygon","coordinates":[[{square}],[{square}]]}}', '{"type":"Point","coordinates":[1,2]}', "broken", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, document string")
    rings = readers.polygon_rings(rows).withColumn("p", geometry.simplified(F.col("points")))
    got = sorted((r.k, r.ring, r.n, r.c and tuple(r.c)) for r in rings.select("k", "ring", F.size("p").alias("n"), geometry.centroid(F.col("p")).alias("c")).collect())
    assert [g[:2] for g in got] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert got[0][2:] == (4, (1.0, 1.0)) and got[1][3] is None


def test_landed_listings_and_pages(spark):
    rows = spark.createDataFrame([(1, "# c\r\nsite\tpeak\r\n15s\t12n\r\n007\t3.5\r\n008\t\r\n"), (2, "# only comments\n"), (3, ""), (4, None)], "k int, document string")
    assert [tuple(r) for r in readers.rdb_documents(rows, "site string, peak double").orderBy("site").collect()] == [(1, "007", 3.5), (1, "008", None)]
    pages = spark.createDataFrame([(1, '{"features":[{"attributes":{"a":1}},{"attributes":{"b":2}}],"exceededTransferLimit":true}'), (2, '{"features":[]}'), (3, "x"), (4, None)], "k int, document string")
    assert sorted(map(tuple, readers.features(pages, "a int").collect()), key=repr) == [(1, True, 1), (1, True, None)]


def test_listed_files_and_links(spark):
    rows = spark.createDataFrame([("data/_a/b.json",), ("data/_b.json",), ("lineage.json",), (None,)], "p string")
    assert [r[0] for r in rows.where(readers.listed(F.col("p"), ["lineage.json"])).collect()] == ["data/_a/b.json"]
    links = spark.createDataFrame([("a",), ("b.pdf",), ("c.PDF",)], "p string")
    assert [r[0] for r in links.select(readers.document_link(F.col("p"))).collect()] == ["a.pdf", "b.pdf", "c.PDF"]
