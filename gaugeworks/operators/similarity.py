"""Analogs of a few queries: exact nearest neighbours by kernel weight or by shared places, and what they suggest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources import scratch

#: Query rows in one block, about (ids are dealt by hash); query rows that are broadcast at most.
BLOCK, BROADCAST = 256, 16_384
#: Members in one list of a place; members of a query's places that are gathered before they are counted.
LISTED, GATHERED = 1_024, 1_048_576


def _best_of_task(batches: Iterator[pa.RecordBatch], asked: pa.Table, keep: int, width: float, bonus: float) -> Iterator[pa.RecordBatch]:
    """(query, neighbour, d2, same): for each query the task's rows that may be among its ``keep`` best, a tile of rows and queries at a time.

    Distances are added up dimension by dimension as the SQL does.  Weights count to
    nine digits; where rounding leaves a doubt, the row stays for the final ranking.
    """
    asked = asked.combine_chunks()
    of, size = asked.column(0).to_numpy(), len(asked)
    q = asked.column(1).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
    kinds = pc.unique(asked.column(2))
    of_kind = pc.index_in(asked.column(2), value_set=kinds).to_numpy()
    blocks = [slice(k, min(k + BLOCK, size)) for k in range(0, size, BLOCK)]
    best = [tuple(np.zeros(0, t) for t in (int, float, float, of.dtype, float, bool)) for _ in blocks]
    least, last = np.full(size, -1.0), np.full(size, np.iinfo(of.dtype).max)
    step = 64  # few rows at first: nothing is ruled out yet
    for batch in batches:
        ids = batch.column(0).to_numpy()
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        kind = pc.fill_null(pc.index_in(batch.column(2), value_set=kinds), -1).to_numpy(zero_copy_only=False)
        done = 0
        while done < len(ids):
            part = slice(done, done + step)
            done, step = done + step, min(4 * step, 1024)
            for b, block in enumerate(blocks):
                d2 = np.zeros((len(ids[part]), block.stop - block.start))
                for j in range(v.shape[1]):
                    gap = v[part, j, None] - q[None, block, j]
                    gap *= gap
                    d2 += gap
                same = kind[part, None] == of_kind[None, block]
                digits = (np.exp(-d2 / (2 * width * width)) + bonus * same) * 1e9 + 0.5
                digits[np.isnan(digits)] = np.inf
                low, high, me = np.floor(digits - 1e-5), np.floor(digits + 1e-5), ids[part, None]
                r, c = np.nonzero(((high > least[block]) | (high == least[block]) & (me <= last[block])) & (me != of[None, block]))
                if not len(r):
                    continue
                new = c + block.start, low[r, c], high[r, c], ids[part][r], d2[r, c], same[r, c]
                at, low, high, who, d2, same = (np.concatenate(x) for x in zip(best[b], new, strict=True))
                order = np.lexsort((who, -low, at))
                first = np.searchsorted(at[order], at[order])
                limit = order[np.arange(len(order)) - first == keep - 1]
                least[at[limit]], last[at[limit]] = low[limit], who[limit]
                stays = (high > least[at]) | (high == least[at]) & (who <= last[at])
                best[b] = tuple(x[stays] for x in (at, low, high, who, d2, same))
    for at, _, _, who, d2, same in best:
        yield pa.RecordBatch.from_arrays([pa.array(of[at]), pa.array(who), pa.array(d2), pa.array(same)], ["query", "neighbour", "d2", "same"])


def _met_in_tiles(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, kind: str, keep: int, width: float, bonus: float) -> DataFrame:
    def plain(x: DataFrame) -> DataFrame:
        return x.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>"), F.col(kind))

    asked, name = rows.sparkSession.sparkContext.broadcast(plain(queries).toArrow()), rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best_of_task(batches, asked.value, keep, width, bonus)

    met = plain(rows).mapInArrow(run, "query long, neighbour long, d2 double, same boolean")
    return met.select(F.col("query").cast(name), F.col("neighbour").cast(name), "d2", "same")


def analogs(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, kind: str, keep: int = 5, width: float = 1.0, bonus: float = 0.1) -> DataFrame:
    """(query, neighbour, rank, weight): the ``keep`` rows of greatest weight for each query row.

    Weight: ``exp(-d**2 / (2 * width**2))`` plus ``bonus`` for an equal kind, d
    the Euclidean distance; ties by id.  A stated query set meets all rows in
    one scan, in blocks of ``BLOCK`` queries; the blocks are broadcast up to
    ``BROADCAST`` queries and dealt with the rows beyond.  Each partition keeps
    its own best before the final ranking.
    """
    n = queries.count()
    lengths = rows.select(vector).unionByName(queries.select(vector)).agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b"), F.bool_or(F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull())).alias("gaps")).first()
    whole = lengths.a is not None and 0 < lengths.a == lengths.b and not lengths.gaps
    if 0 < n <= BROADCAST and whole and rows.schema[id_col].dataType.simpleString() in ("int", "bigint"):
        met = _met_in_tiles(rows, queries, id_col, vector, kind, keep, width, bonus)
        d2, same = F.col("d2"), F.col("same")
    else:  # vectors with gaps or of several lengths, other ids, more queries
        ids = queries.select(F.col(id_col).alias("query"), F.col(vector).alias("_q"), F.col(kind).alias("_k"))
        blocks = ids.groupBy(F.pmod(F.xxhash64("query"), F.lit(max(-(-n // BLOCK), 1)))).agg(F.collect_list(F.struct("query", "_q", "_k")).alias("_block")).select("_block")
        if n <= BROADCAST:
            blocks = F.broadcast(blocks)
        met = rows.select(F.col(id_col).alias("neighbour"), F.col(vector).alias("_v"), F.col(kind).alias("_kind")).join(blocks).select("neighbour", "_v", "_kind", F.inline("_block"))
        d2 = F.aggregate(F.zip_with("_v", "_q", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        same = F.col("_kind").eqNullSafe(F.col("_k"))
    weight = F.exp(-d2 / (2 * width * width)) + F.when(same, F.lit(bonus)).otherwise(F.lit(0.0))
    pairs = met.where("neighbour <> query").select("query", "neighbour", F.round(weight, 9).alias("weight"))
    top = Window.partitionBy("query").orderBy(F.desc("weight"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= keep)


def _counted(others: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct members in their order and how often each was met."""
    who, n = np.concatenate(others), np.concatenate(times)
    order = np.argsort(who, kind="stable")
    who, n = who[order], n[order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)])
    return who[first], np.add.reduceat(n, first) if len(first) else n


def _most_shared(query: int, lists: Iterator[np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` members that are met most often in the lists, the smaller of equals; the query is none of them."""
    others, times, held = [], [], 0
    for members in lists:
        others.append(members)
        times.append(np.ones(len(members), np.int64))
        held += len(members)
        if held >= GATHERED:
            who, n = _counted(others, times)
            others, times, held = [who], [n], 0
    who, n = _counted(others, times)
    who, n = who[who != query], n[who != query]
    if len(n) > keep:
        likely = n >= np.partition(n, -keep)[-keep]
        who, n = who[likely], n[likely]
    best = np.argsort(-n, kind="stable")[:keep]
    return who[best], n[best]


def most_shared(rows: DataFrame, member: str, place: str, asked: Column, keep: int = 5) -> DataFrame:
    """(query, other, shared, rank): the ``keep`` other members that share most places with each member that is ``asked``.

    Members are whole numbers and may be repeated in a place; ties go to the
    smaller.  Members of a place are listed in arrays of ``LISTED`` at most;
    lists, not pairs, are dealt to the queries, each of which counts its own.
    """
    feet = rows.where(F.col(member).isNotNull() & F.col(place).isNotNull()).select(F.col(place).alias("place"), F.col(member).cast("long").alias("member")).distinct()
    part = F.row_number().over(Window.partitionBy("place").orderBy("member")) - 1
    lists = feet.withColumn("part", F.floor(part / LISTED)).groupBy("place", "part").agg(F.collect_list("member").alias("members"))
    lists = scratch.written(lists.select("place", "members"), "footprints")
    queries = lists.select("place", F.explode("members").alias(member)).where(asked).select("place", F.col(member).alias("query"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = key[0].as_py()
        who, n = _most_shared(query, (b.column("members").flatten().to_numpy() for b in batches), keep)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), query)), pa.array(who), pa.array(n), pa.array(np.arange(1, len(who) + 1, dtype=np.int32))], ["query", "other", "shared", "rank"])

    met = queries.join(lists, "place").select("query", "members")
    return met.groupBy("query").applyInArrow(run, "query long, other long, shared long, rank int")


def suggested(neighbours: DataFrame, facts: DataFrame, targets: DataFrame, fact: str, target: str, amount: str, people: str, tails: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    """(query, analogs, low, typical, high, expected): what the analogs' costs mean for the queries' own people.

    ``neighbours`` is (query, neighbour, weight) with a few rows a query;
    ``facts`` has each neighbour's amount and people, ``targets`` the queries'
    people.  Amounts a head are weighted: ``low`` and ``high`` are their
    ``tails`` and ``typical`` their median, a quantile being the least value
    whose running weight reaches its share; ``expected`` is their weighted mean.
    All are scaled to the target's people.  Neighbours without people, amount or
    weight say nothing.
    """
    known = facts.select(F.col(fact).alias("neighbour"), F.col(amount).cast("double").alias("_a"), F.col(people).cast("double").alias("_n")).where("_n > 0 and _a is not null")
    heads = neighbours.where("weight > 0").join(known, "neighbour").select("query", "neighbour", "weight", (F.col("_a") / F.col("_n")).alias("_x"))
    order = Window.partitionBy("query").orderBy("_x", "neighbour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = heads.withColumns({"_upto": F.sum("weight").over(order), "_all": F.sum("weight").over(Window.partitionBy("query"))})

    def reached(share: float):
        return F.min(F.when(F.col("_upto") >= F.col("_all") * share * (1 - 1e-12), F.col("_x")))

    found = running.groupBy("query").agg(
        F.count("*").alias("analogs"), reached(tails[0]).alias("low"), reached(0.5).alias("typical"), reached(tails[1]).alias("high"), (F.sum(F.col("weight") * F.col("_x")) / F.sum("weight")).alias("expected")
    )
    own = targets.select(F.col(target).alias("query"), F.col(people).cast("double").alias("_people"))
    return found.join(own, "query").select("query", "analogs", *((F.col(c) * F.col("_people")).alias(c) for c in ("low", "typical", "high", "expected")))
