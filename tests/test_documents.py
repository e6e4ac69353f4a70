"""Lists out of scripts, dates out of JSON of any shape, and listings searched by parts of names."""

from __future__ import annotations

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import payloads
from gaugeworks.operators import containment


def cut_out(text, name):
    """The list after a name, character by character."""
    i = text.find(name)
    i = text.find("[", i + len(name)) if i >= 0 else -1
    depth, quote = 0, None
    for j in range(i, len(text)) if i >= 0 else ():
        c = text[j]
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"" and c in text[j + 1 :]:
            quote = c
        else:
            depth += (c == "[") - (c == "]")
            if depth == 0:
                return text[i : j + 1]
    return None


def test_bracketed_is_a_scan_of_characters(spark):
    rng = random.Random(2)
    texts = ["", "q", "q=", "q=]", "x[1] q = [[1,'2]'],[3]]; [4]", "q=[1,[2", "qq=['a\"]b',\"c]'d\"]", "q=[\n[1],\n[2]]", "q=[']"]
    texts += ["q" + "".join(rng.choice("[[]]'\"a1,") for _ in range(rng.randint(0, 25))) for _ in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r.i: r.b for r in rows.select("i", payloads.bracketed(F.col("t"), "q").alias("b")).collect()}
    assert got == {-1: None, **{i: cut_out(t, "q") for i, t in enumerate(texts)}}


def test_labels_fall_back_to_the_standard_ones(spark):
    rows = [(1, [["1"], ["2"]], ["a", "b"]), (2, [["1"], ["2"]], ["a"]), (3, [["1"], ["2"]], None), (4, [["1"]], None), (5, None, ["a"]), (6, [["1"]], ["z"]), (7, [], [])]
    df = spark.createDataFrame(rows, "i int, v array<array<string>>, l array<string>")
    got = {r.i: r.x and [(y.label, y.row) for y in r.x] for r in df.select("i", payloads.labelled_rows(F.col("v"), F.col("l"), ["s", "t"]).alias("x")).collect()}
    assert got == {1: [("a", ["1"]), ("b", ["2"])], 2: [("s", ["1"]), ("t", ["2"])], 3: [("s", ["1"]), ("t", ["2"])], 4: None, 5: None, 6: [("z", ["1"])], 7: None}
    days = spark.createDataFrame([("1-day",), (" 60-DAY ",), ("30day",), ("2-hr",), ("x-day",), (None,)], "l string")
    assert [r[0] for r in days.select(payloads.whole_days(F.col("l"))).collect()] == [1, 60, 30, None, None, None]


def stated(d):
    for k in payloads.DATE_KEYS:
        if d.get(k) and not isinstance(d[k], (list, dict)):
            return str(d[k]).lower() if d[k] is True else str(d[k])
    vs = [str(v) for v in d["asOf"].values() if v and not isinstance(v, (list, dict))] if isinstance(d.get("asOf"), dict) else []
    return max(vs) if vs else None


def plain_date(doc, today):
    if isinstance(doc, dict):
        if (v := stated(doc)) is not None:
            return v
        for s in payloads.SECTIONS:
            if isinstance(doc.get(s), dict):
                if (v := stated(doc[s])) is not None:
                    return v
                if doc[s].get("to") and not isinstance(doc[s]["to"], (list, dict)):
                    return str(doc[s]["to"])
    best, stack = None, [doc]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            best = max([best or "", *(m for m in re.findall(r"\b(20\d\d-\d\d-\d\d)\b", x) if m <= today)]) or None
        elif isinstance(x, (dict, list)):
            stack.extend(x.values() if isinstance(x, dict) else x)
    return best


def test_freshness_of_documents_of_any_shape(spark):
    rng = random.Random(4)

    def day():
        return str(datetime.date(2015, 1, 1) + datetime.timedelta(rng.randrange(4000)))

    def leaf():
        return rng.choice([day(), f'see "{day()}", not {day()}x', "", None, 0, 7, 2.5, f"{day()}\\\": é", f'"{day()}":'])

    def node(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return leaf()
        if kind < 0.5:
            return [node(depth - 1) for _ in range(rng.randint(0, 4))]
        keys = rng.sample([*payloads.DATE_KEYS, "to", "a", f"k {day()}", "b", "asOf", "meta", "coverage"], rng.randint(0, 5))
        return {k: rng.choice(["", day(), None, 0]) if k in payloads.DATE_KEYS or k == "to" else {x: rng.choice(["", day(), None]) for x in "xy"[: rng.randint(0, 2)]} if k == "asOf" and kind < 0.9 else node(depth - 1) for k in keys}

    docs = [node(5) for _ in range(600)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, None), (-2, "{broken")], "i int, t string")
    got = {r.i: r.f for r in rows.select("i", payloads.freshness_date(F.try_parse_json("t"), F.lit("2022-06-30")).alias("f")).collect()}
    assert {i: f and f.date for i, f in got.items()} == {-1: None, -2: None, **{i: plain_date(d, "2022-06-30") for i, d in enumerate(docs)}}
    assert {f.way for f in got.values() if f} == {"key", "as of", "section", "newest"}


@pytest.mark.parametrize("gram", [2, 3, 6])
def test_candidates_are_those_of_comparing_all(spark, gram):
    rng = random.Random(gram)
    names = [(i, "".join(rng.choice("aAbB c") for _ in range(rng.randint(0, 14)))) for i in range(250)] + [(900, None)]
    wanted = [(i, "".join(rng.choice("abC ") for _ in range(rng.randint(0, 5))) or None, rng.choice("abcz")) for i in range(120)] + [(500, "", "a"), (501, None, "a")]
    listing = spark.createDataFrame(names, "entry int, name string")
    asked = spark.createDataFrame(wanted, "q int, town string, river string")
    got = {tuple(r) for r in containment.candidates(asked, listing, "q", ["town", "river"], "entry", "name", keep=5, gram=gram).collect()}
    expected = set()
    for q, town, river in wanted:
        if town:
            fits = [i for i, n in names if n is not None and town.lower() in n.lower() and river.lower() in n.lower()]
            expected |= {(q, i, k + 1) for k, i in enumerate(sorted(fits)[:5])}
    assert got == expected and any(r == 5 for _, _, r in got)


def test_search_meets_no_one_without_a_common_gram(spark):
    listing = spark.range(300).select(F.col("id").alias("entry"), F.concat(F.lit("gauge "), F.col("id")).alias("name"))
    asked = spark.range(300).select(F.col("id").alias("q"), F.concat(F.lit("E "), F.col("id")).alias("town"))
    found = containment.candidates(asked, listing, "q", ["town"], "entry", "name")
    details = spark.range(300).select(F.col("id").alias("entry"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-1).alias("claim"))
    sure = containment.confirmed(found, details, "entry", "claim")
    plan = sure._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    hits = {r.query: (r.entry, r.rank, r.tried) for r in sure.collect()}
    assert hits[2] == (2, 1, 1) and hits[3] == (None, None, 5) and hits[12] == (12, 1, 1) and len(hits) == 300
    assert containment.candidates(asked.limit(0), listing, "q", ["town"], "entry", "name").count() == 0
