"""The GNU headers are told from their neighbours."""

from __future__ import annotations

from gaugeworks.llm import license_scan

HEAD = "xx yy zz {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. and more words follow"


def test_gnu_headers(spark):
    want = {1: "GPL-2.0", 2: "GPL-3.0", 3: "LGPL-2.1", 4: "LGPL-3.0", 5: "AGPL-3.0"}
    given = [("This program", "General Public License", "2"), ("This program", "General Public License", "3"), ("This library", "Lesser General Public License", "2.1"), ("This program", "Lesser General Public License", "3"), ("This program", "Affero General Public License", "3")]
    docs = spark.createDataFrame([(k, HEAD.format(*g)) for k, g in enumerate(given, 1)], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in license_scan.licenses(docs).orderBy("doc_id", "license").collect()] == sorted(want.items())
