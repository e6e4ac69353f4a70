"""Searching a listing by parts of names, without a common key: an inverted index of character grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct grams of ``size`` characters of a text that has at least as many."""
    n = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    return F.array_distinct(F.transform(places, lambda p: F.substr(text, p, n)))


def candidates(wanted: DataFrame, listing: DataFrame, query: str, needles: Sequence[str], entry: str, name: str, keep: int = 5, gram: int = 6) -> DataFrame:
    """(query, entry, rank): the first ``keep`` entries, by entry, whose name contains every needle, letter case aside.

    A name that contains a needle holds all its grams, so each query meets only
    the entries listed under its rarest gram, and these are compared as strings;
    a gram that no entry holds ends the search.  Needles shorter than ``gram``
    have one gram, themselves, and the index lists grams of their lengths too.
    Queries without any needle, or with a null one, find nothing.  Sides are
    shuffled and sorted: the sizes that Spark expects of exploded grams are those of
    the files, so it would take an index of all names for small and broadcast it.
    """
    asked = wanted.select(F.col(query).alias("query"), *(F.lower(n).alias(f"_n{i}") for i, n in enumerate(needles)))
    sizes = [F.least(F.length(f"_n{i}"), F.lit(gram)) for i in range(len(needles))]
    asked = asked.where(" and ".join(f"_n{i} <> ''" for i in range(len(needles))))
    parts = F.array_distinct(F.flatten(F.array(*(_grams(F.col(f"_n{i}"), s) for i, s in enumerate(sizes)))))
    of_query = asked.select("query", F.explode(parts).alias("gram"))
    lengths = [r[0] for r in of_query.select(F.length("gram")).distinct().collect()]  # ``gram`` numbers at most
    names = listing.select(F.col(entry).alias("entry"), F.lower(name).alias("_name"))
    held = F.flatten(F.array(*(F.coalesce(_grams(F.col("_name"), n), F.array().cast("array<string>")) for n in sorted(lengths or [gram]))))
    index = names.select("entry", F.explode(held).alias("gram"))
    index = index.join(of_query.select("gram").distinct().hint("merge"), "gram", "left_semi")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_query.join(often.hint("merge"), "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("query", F.col("r.gram").alias("gram"))
    met = rarest.join(index.hint("merge"), "gram").select("query", "entry").join(asked.hint("merge"), "query").join(names.hint("merge"), "entry")
    met = met.where(" and ".join(f"contains(_name, _n{i})" for i in range(len(needles))))
    order = Window.partitionBy("query").orderBy("entry")
    return met.select("query", "entry", F.row_number().over(order).alias("rank")).where(F.col("rank") <= keep)


def confirmed(found: DataFrame, details: DataFrame, entry: str, claim: str) -> DataFrame:
    """(query, entry, rank, tried): the first candidate whose own details claim the query's id, and how many were looked up; null entry if none does."""
    own = details.select(F.col(entry).alias("entry"), F.col(claim).alias("_claim"))
    tried = found.join(own.hint("merge"), "entry", "left").groupBy("query").agg(F.min(F.when(F.col("_claim") == F.col("query"), F.struct("rank", "entry"))).alias("hit"), F.count("*").alias("n"))
    return tried.select("query", F.col("hit.entry").alias("entry"), F.col("hit.rank").alias("rank"), F.coalesce("hit.rank", F.col("n")).cast("long").alias("tried"))
