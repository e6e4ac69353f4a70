"""Periodic runs of words in whole texts, and the texts with each run cut to its first period.

Every text is handled by itself inside a task (``runs.py`` has the method), so
nothing is shuffled; the state is a few dozen bytes a word of one text.

Defined results: a null or empty text has no words, no runs and an empty rest;
rows without an id and rows that share an id are rows like others, each with its
own result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .oracles import CRC32
from .runs import runs_of

#: Whole periods and words of a run at least.
POWER, LEAST = 4, 6
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def repeated_runs(docs: DataFrame, power: int = POWER, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, rest) for every row of ``docs`` (doc_id, text).

    ``runs``: start, length and period in words of every maximal run of at least
    ``power`` (two or more) periods and ``least`` words, ordered by start and
    period.  ``rest``: the words, joined by one space, without those that any
    run holds after its first period.  Words are `[^\\x20\\x09-\\x0D]+`, compared
    as they stand.
    """
    if power < 2:
        raise ValueError("a run has two periods at least")
    of_id = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rests = [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                words = (text or b"").split()  # of bytes: splits at these six bytes alone
                ids: dict[bytes, int] = {}
                runs = runs_of(np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64), power, least)
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for begin, end, period in runs:
                    gone[begin + period] += 1
                    gone[end] -= 1
                if runs:
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                found.append([{"start": b, "length": e - b, "period": p} for b, e, p in runs])
                rests.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, _RUNS), pa.array(rests, pa.large_binary()).cast(pa.large_string())], ["doc_id", "runs", "rest"]
            )

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {of_id.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, rest string")


def with_repeating_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) whose tenth by hash of the id has a tail that repeats, by the rule of the query's contract.

    With n words, h the crc32 of the id in decimal digits and g = h div 10,
    texts of h mod 10 = 0 go on from word a = g mod n by repeating the 1 + (n - a)
    div (3 + g mod 8) words from there.  Rows without an id or words stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_a", F.expr("if(_n > 0, cast(_g % _n as int), 0)"))
    rows = rows.withColumn("_p", F.expr("1 + cast((_n - _a) div (3 + _g % 8) as int)"))
    # whole copies of the repeated words beyond the end, then cut
    tail = F.expr("slice(flatten(array_repeat(slice(_w, _a + 1, _p), 1 + cast((_n - _a) div _p as int))), 1, _n - _a)")
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(F.expr("slice(_w, 1, _a)"), tail), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query's contract from ``repeated_runs``."""
    length: Column = F.expr("aggregate(runs, 0L, (x, r) -> greatest(x, r.length))")
    longest = F.expr("filter(runs, r -> r.length = _longest)[0]")  # ordered by start and period already
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.withColumn("_longest", length).withColumn("_run", F.when(F.size("runs") > 0, longest))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_run.start").alias("start"),
        F.col("_run.length").alias("length"),
        F.col("_run.period").alias("period"),
        F.expr("1000 * _run.length div _run.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("rest").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Equal words at a distance q, in stretches of consecutive places, are the runs of period q.
ORACLE_SQL = (
    r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, case when doc_id is null then 1 else """
    + CRC32.format("doc_id::varchar")
    + """ end as h from documents),
e as (select doc_id, w, len(w) as n, h, h // 10 as g from d),
f as (select *, case when n > 0 then g % n else 0 end as a from e),
t as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + 1 + (i - a) % (1 + (n - a) // (3 + g % 8))] end) else w end as w from f),
spot as (select doc_id, n, unnest(w) as x, unnest(range(0, n)) as i from t),
twice as (select p.doc_id, q.i - p.i as q, p.i from spot p join spot q on p.doc_id = q.doc_id and p.x = q.x and q.i > p.i and 4 * (q.i - p.i) <= p.n),
island as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from twice),
stretch as (select doc_id, min(i) as start, count(*) + q as length, q from island group by doc_id, q, k),
run as (select doc_id, start, length, min(q) as period from stretch where length >= greatest(6, 4 * q) group by doc_id, start, length),
per as (select doc_id, count(*) as n_runs, max(length) as longest, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from run group by doc_id),
best as (select doc_id, first({'start': start, 'length': length, 'period': period} order by start, period) as r from run join per using (doc_id) where length = longest group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (select doc_id, string_agg(x, ' ' order by i) as rest from spot anti join gone using (doc_id, i) group by doc_id)
select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, r.start::bigint as start, r.length::bigint as length, r.period::bigint as period,
(1000 * r.length // r.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(rest, '')) as collapsed_sha256
from t left join per using (doc_id) left join best using (doc_id) left join kept using (doc_id)
"""
)
