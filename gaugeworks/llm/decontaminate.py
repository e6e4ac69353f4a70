"""Benchmark items inside long documents, by size-partitioned MinHash containment.

Items are small sets of five-word shingles, documents are large ones, so the
Jaccard similarity of a pair says little and the containment of the item does.
Items are partitioned by set size, sizes doubling from class to class.  Each
class has its own sketch, the ``SKETCH`` times class number least shingle hashes
of an item, and its own least number of sketch hashes that a document must hold:
five standard deviations below what the wanted containment gives for that sketch
length, so that a contaminated document fails with a chance below one in a
million.  Classes up to 32 shingles keep whole sets and lose nothing at all.  A
document is probed with all its shingles, so its length does not weaken the
search, and only for the classes whose items it is large enough to hold.  Candidates are then verified: the share
of the item's distinct shingles, compared as strings, that the whole document
holds.

DataFrame operations only.  Documents are read in place: the sketches go to
them (broadcast while small, else both sides are shuffled by hash), and the
only group key is (document, item).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, by_ids

WIDTH, CONTAINMENT, SKETCH = 5, 0.8, 8
#: Sketch rows that are broadcast at most, about 40 MB; sets: shingle rows with their strings.
BROADCAST_SKETCHES, BROADCAST_SHINGLES = 500_000, 200_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingle(tokens: str, width: int) -> Column:
    return F.concat_ws(" ", *(F.get(tokens, F.col("at") + k) for k in range(width)))


def _hash(tokens: str, width: int) -> Column:
    return F.xxhash64(*(F.get(tokens, F.col("at") + k) for k in range(width)))


def _positions(rows: DataFrame, tokens: str, width: int) -> DataFrame:
    """One row for each shingle place; rows of fewer words have none."""
    return rows.where(F.size(tokens) >= width).withColumn("at", F.explode(F.sequence(F.lit(0), F.size(tokens) - width)))


def item_sketches(items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT, sketch: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, text) as shingles (item_id, shingle, n_item) and sketches (item_id, size_class, least_size, hash, least_hits)."""
    tokens = items.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"), words(F.col("text")).alias("words"))
    every = _positions(tokens, "words", width).select("item_id", _shingle("words", width).alias("shingle"), _hash("hashes", width).alias("hash")).distinct()
    per_item = Window.partitionBy("item_id")
    counted = every.withColumn("n_item", F.count("*").over(per_item)).withColumn("rank", F.row_number().over(per_item.orderBy("hash", "shingle")))
    shingles = counted.select("item_id", "shingle", "n_item")
    # class c holds the sizes above 2**(c - 1) and up to 2**c; the first one 1 and 2
    classed = counted.withColumn("size_class", F.greatest(F.lit(1), F.ceil(F.log2("n_item")).cast("int")))
    length = sketch * F.col("size_class")
    k = F.least("n_item", length)
    least = F.greatest(F.lit(1), F.floor(k * containment - 5 * F.sqrt(k * containment * (1 - containment))))
    smallest = F.when(F.col("size_class") == 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.col("size_class") - 1) + 1)
    sketches = classed.where(F.col("rank") <= length).select(
        "item_id", "size_class", F.ceil(smallest * containment).cast("int").alias("least_size"), "hash", F.when(F.col("n_item") <= length, F.ceil(k * containment)).otherwise(least).cast("long").alias("least_hits")
    )
    return shingles, sketches


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = CONTAINMENT,
    width: int = WIDTH,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): pairs at ``containment`` or more.

    n_item counts an item's distinct shingles of five words (lower-cased runs of
    letters and digits), n_shared those that the document holds anywhere.
    Items of fewer than five words have no shingle and match nothing; null and
    empty texts likewise; rows with a null id are left out.  Repeated rows count
    once: pairs are distinct, and rows that share an id count as one text.  Of
    items that share an id the shingles count as one item's.  An
    empty table on either side gives an empty result.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null")
    shingles, sketches = item_sketches(items, width, containment)
    shingles, sketches = scratch.table(shingles, "shingles"), scratch.table(sketches, "sketches")

    probes = F.broadcast(sketches) if sketches.count() <= BROADCAST_SKETCHES else sketches
    tokens = texts.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"), F.lit(False).alias("apart"))
    # an id of several rows is one text, whose size no row tells: all its rows are probed
    twice = scratch.table(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        tokens = by_ids(tokens, twice, "left_anti").unionByName(by_ids(tokens, twice, "left_semi").withColumn("apart", F.lit(True)))
    hits = (
        _positions(tokens, "hashes", width)
        .select("doc_id", "apart", (F.size("hashes") - width + 1).alias("places"), _hash("hashes", width).alias("hash"))
        .join(probes, "hash")
        .where("apart or places >= least_size")
        .groupBy("doc_id", "item_id", "size_class", "least_hits", "hash")
        .agg(F.lit(1).alias("held"))
        .groupBy("doc_id", "item_id", "size_class", "least_hits")
        .agg(F.count("*").alias("hits"))
    )
    pairs = scratch.table(hits.where("hits >= least_hits").select("doc_id", "item_id"), "pairs")

    ids = scratch.table(pairs.select("doc_id").distinct(), "ids")
    held = by_ids(texts, ids, "left_semi").select("doc_id", words(F.col("text")).alias("words"))
    wanted = F.broadcast(shingles) if shingles.count() <= BROADCAST_SHINGLES else shingles
    return (
        _positions(held, "words", width)
        .select("doc_id", _shingle("words", width).alias("shingle"))
        .join(wanted, "shingle")
        .distinct()
        .groupBy("doc_id", "item_id", "n_item")
        .agg(F.count("*").alias("n_shared"))
        .where(F.col("n_shared") >= F.col("n_item") * F.lit(containment))
        .join(pairs, ["doc_id", "item_id"], "left_semi")
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def without_contaminated(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents in ``leaks``; all columns stay, null ids too; null ids in ``leaks`` take nothing away."""
    scratch = Scratch(docs.sparkSession, "clean")
    ids = scratch.table(leaks.select(F.col("doc_id").alias(id_col)).distinct(), "ids")
    return by_ids(docs, ids, "left_anti")


ORACLE_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where doc_id is not null),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
ds as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
bs as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 3)) as i from b where len(w) >= 5)),
n as (select item_id, count(*) as n_item from bs group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item, count(*) / any_value(n_item) as containment
from ds join bs using (s) join n using (item_id)
group by doc_id, item_id
having count(*) >= any_value(n_item) * cast(0.8 as double)
"""
