"""Near-duplicate documents by one-permutation MinHash and star-shaped candidates.

Plan
----
1. A sketch of each document: its distinct five-word shingles fall into bins by
   hash, each bin keeps its least hash, and an empty bin copies the bin that
   comes first in its own fixed permutation of all bins (optimal
   densification).  ``BANDS`` bands of ``ROWS`` bins are hashed to bucket keys.
   A pair at Jaccard 0.85 misses every band with probability
   (1 - 0.85**6)**32, about 3e-7.
2. Equal sets form classes by a 128-bit key; the least id stands for a class,
   so copies never meet as pairs.
3. In a bucket, candidates form a star around one hub, the member whose buckets
   are largest in sum (a copied original shares more buckets with its copies
   than they do with each other).  Every candidate is confirmed on full sets.
4. A star may miss a link between two of its rays.  Rays that link with the hub
   are together already.  If u does not link with hub h, a link between u and y
   needs enough in common outside what both keep of h: at least
   ``least - |h| + max(lost by u, lost by y)`` shingles that both added to h,
   where ``least`` is the intersection that the threshold asks of |u| and |y|.
   Where that number is not positive, they share an added one or one that both
   lost.  So the rays' differences from their hub are indexed, each ray under as many
   of its rarest ones as it takes to meet every ray that it may link with, and
   pairs that meet are compared by what they lost and added, which tells their
   full intersection.  No pairs of a group are listed for being in one group,
   and no link between bucket members is lost to the star shape.

Components come from ``components``; nothing but emptiness checks reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import mapped
from .components import components
from .store import Scratch, by_ids
from .words import Words, distinct_sorted, mix, odd_constants, slices

BANDS, ROWS, WIDTH, PERCENT = 32, 6, 5, 85
_SEED = 20240311


@lru_cache(4)
def _permutations(bins: int) -> np.ndarray:
    """For each bin its own fixed permutation of all bins."""
    return np.argsort(np.random.default_rng(_SEED).random((bins, bins)), axis=1)


def densified(values: np.ndarray, rows: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` minima for each set of sorted distinct hashes; no set is empty.

    The bin is the hash's leading part, so a sorted set meets its bins in order
    and the first hash in a bin is its minimum.
    """
    n = len(rows) - 1
    owner = np.repeat(np.arange(n), np.diff(rows))
    place = owner * bins + ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    flat, filled = np.zeros(n * bins, dtype=np.uint64), np.zeros(n * bins, dtype=bool)
    flat[place[first]] = values[first]
    filled[place[first]] = True
    order = _permutations(bins)
    empty = np.flatnonzero(~filled)
    row, col = (empty // bins) * bins, empty % bins
    for attempt in range(bins):
        if not len(row):
            break
        source = row + order[col, attempt]
        hit = filled[source]
        flat[row[hit] + col[hit]] = flat[source[hit]]
        row, col = row[~hit], col[~hit]
    return flat.reshape(n, bins)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys (documents x bands) of a signature; the band's number is part of the key."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.zeros((len(signature), bands), dtype=np.uint64)
    for k, c in enumerate(odd_constants(rows, 5)):
        keys += (parts[:, :, k] ^ c) * c
    return mix(keys + odd_constants(bands, 9)[None, :]).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")


def _set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit keys of sorted sets, 0 of empty ones."""
    key = np.zeros((len(at) - 1, 2), dtype=np.int64)
    for i in np.flatnonzero(np.diff(at)):
        key[i] = np.frombuffer(hashlib.blake2b(values[at[i] : at[i + 1]].tobytes(), digest_size=16).digest(), dtype=np.int64)
    return key


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): set size, 128-bit key of the set and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                values, at = distinct_sorted(*Words(part.column("text")).shingles(width))
                n = np.diff(at)
                key = _set_keys(values, at)
                some = np.flatnonzero(n)
                keys = band_keys(densified(values, np.concatenate([[0], np.cumsum(n[some])]), bands * rows), bands, rows)
                ends = np.zeros(len(n) + 1, dtype=np.int32)
                ends[1:] = np.cumsum(np.where(n > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return mapped(_texts(docs, id_col, text_col), run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, k1, k2, items): each document's distinct shingle hashes and their key; docs has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                values, at = distinct_sorted(*Words(part.column("text")).shingles(width))
                items = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                key = _set_keys(values, at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key[:, 0]), pa.array(key[:, 1]), items], names=["doc_id", "k1", "k2", "items"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, k1 long, k2 long, items array<long>")


def _rays(compared: DataFrame, comp: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between rays of one star that are not connected yet."""
    groups = scratch.table(
        compared.groupBy("hub").agg(F.count("*").alias("rays"), F.count_if(~F.col("link")).alias("apart")).where("rays > 1 and apart > 0").select("hub"), "groups"
    )
    if groups.isEmpty():
        return groups.select(F.col("hub").alias("a"), F.col("hub").alias("b"))
    rays = compared.join(groups, "hub", "left_semi").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    rays = scratch.table(rays.withColumn("comp", F.coalesce("component_id", "rep")).drop("component_id"), "rays")
    pairs = scratch.table(meeting(rays, percent, scratch), "pairs")
    x = rays.select("hub", "hub_n", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("lost").alias("al"), F.col("added").alias("aa"))
    z = rays.select("hub", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("lost").alias("bl"), F.col("added").alias("ba"))
    shared = F.col("hub_n") - F.size(F.array_union("al", "bl")) + F.size(F.array_intersect("aa", "ba"))
    both = pairs.join(x, ["hub", "a"]).join(z, ["hub", "b"]).where((100 + percent) * shared >= percent * (F.col("an") + F.col("bn")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def meeting(rays: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, a, b): rays of one star that may link and are not connected; no link is left out.

    ``rays``: hub, hub_n, rep, n, lost, added, link, comp, in a written table.
    Two rays share |h| - lost(u) - lost(y) + common lost + common added, so a
    link needs ``least - |h| + lost(u) + lost(y)`` common differences, one at least
    where one of them is not linked with the hub.  Rays are classed by size and
    number lost.  For each class that may hold a partner a ray is listed under
    its rarest differences only, as many as leave fewer than are needed, counting
    those that another ray of the star has too.  So what many rays lost or added
    (a footer, say) pairs none for its own sake.
    """
    lost = F.size("lost")
    step = (F.floor(F.log(F.col("n")) / F.log(F.lit(1.03))) * 1000 + F.floor(F.log1p(lost) / F.log(F.lit(1.12)))).cast("int")
    facts = rays.select("hub", "hub_n", "rep", "n", "link", "comp", lost.alias("l"), (lost + F.size("added")).alias("d"), step.alias("c"))
    classes = facts.groupBy("hub", F.col("c").alias("with")).agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("l").alias("least_l"), F.bool_or(~F.col("link")).alias("apart"))
    tagged = [rays.select("hub", "rep", F.col("link"), F.explode(kind).alias("item"), F.lit(kind == "lost").alias("gone")) for kind in ("lost", "added")]
    items = tagged[0].unionByName(tagged[1])
    common = items.groupBy("hub", "gone", "item").agg(F.count("*").alias("rays"), F.count_if(~F.col("link")).alias("apart")).where("rays > 1 and apart > 0")
    mine = Window.partitionBy("hub", "rep")
    listed = items.drop("link").join(scratch.table(common.select("hub", "gone", "item", "rays"), "common"), ["hub", "gone", "item"])
    ranked = scratch.table(
        listed.select("hub", "rep", "gone", "item", F.count("*").over(mine).alias("held"), F.row_number().over(mine.orderBy("rays", "gone", "item")).alias("rank")), "ranked"
    )
    # what any partner of a class asks for at least
    asked = F.greatest(F.ceil(percent * (F.col("n") + F.col("least_n")) / (100 + percent)) - F.col("hub_n") + F.col("l") + F.col("least_l"), F.lit(1))
    sizes = (100 * F.col("n") >= percent * F.col("least_n")) & (100 * F.col("most_n") >= percent * F.col("n"))
    wanted = facts.join(scratch.table(classes, "classes"), "hub").where((~F.col("link") | F.col("apart")) & sizes).withColumn("asked", asked).where(F.col("asked") <= F.col("d"))
    wanted = wanted.select("hub", "rep", F.least("c", "with").alias("c1"), F.greatest("c", "with").alias("c2"), "asked", F.struct("rep", "n", "link", "comp", "l", "d", "c", "hub_n").alias("r"))
    kept = scratch.table(
        wanted.join(ranked, ["hub", "rep"]).where(F.col("rank") <= F.col("held") - F.col("asked") + 1).select("hub", "c1", "c2", "gone", "item", "r"), "kept"
    )
    u, y = kept.withColumnRenamed("r", "u"), kept.withColumnRenamed("r", "y")
    few, many = F.least("u.n", "y.n"), F.greatest("u.n", "y.n")
    need = F.ceil(percent * (F.col("u.n") + F.col("y.n")) / (100 + percent)) - F.col("u.hub_n") + F.col("u.l") + F.col("y.l")
    once = F.when(F.col("c1") == F.col("c2"), F.col("u.rep") < F.col("y.rep")).otherwise((F.col("u.c") == F.col("c1")) & (F.col("y.c") == F.col("c2")))
    may = once & (F.col("u.comp") != F.col("y.comp")) & ~(F.col("u.link") & F.col("y.link")) & (100 * few >= percent * many) & (need <= F.least("u.d", "y.d"))
    return u.join(y, ["hub", "c1", "c2", "gone", "item"]).where(may).select("hub", F.col("u.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _one_set(sk: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Sketches with one set an id; where ids have several, the rows as they were given come second."""
    ends = F.struct("n_shingles", "k1", "k2")
    several = scratch.table(sk.groupBy("doc_id").agg(F.min(ends).alias("least"), F.max(ends).alias("most")).where("least <> most").select("doc_id", "least.*"), "several")
    if several.isEmpty():
        return sk, None
    rest = by_ids(sk, several.select("doc_id"), "left_anti")
    one = sk.join(several, ["doc_id", "n_shingles", "k1", "k2"], "left_semi").dropDuplicates(["doc_id"])
    return scratch.table(rest.unionByName(one), "sketches"), sk.select("doc_id")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    width: int = WIDTH,
    links_too: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id, kept, class_id) for each row of ``docs``.

    Links join documents with 100 * intersection >= percent * union of their
    distinct shingles.  Null or blank texts have no shingles, link with nothing
    and are kept.  Texts of fewer than five words have one shingle, their whole
    word sequence.  Equal sets share a ``class_id``, the least id among them.
    Rows with a null id are no documents and are left out; repeated rows come
    back as often as they were given.  Rows that share an id but not the text are
    one document under that id, and the one of the least set key is its text; all
    of them come back with that document's values.  An empty table gives an empty
    result, and other columns of ``docs`` are not read.  With ``links_too`` the confirmed
    links between classes, (a, b), come second.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    sk = scratch.table(sketches(docs, id_col, text_col, bands, rows, width), "sketches")
    sk, given = _one_set(sk, scratch)
    classes = scratch.table(
        sk.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes"
    )
    rep_bands = sk.join(classes.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
    spread = rep_bands.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n")).distinct()
    buckets = scratch.table(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = scratch.table(spread.join(buckets, "key"), "members")
    fame = scratch.table(members.groupBy("rep").agg(F.sum("size").alias("fame")), "fame")
    famous = scratch.table(members.join(fame, "rep"), "famous")
    hubs = scratch.table(
        famous.groupBy("key")
        .agg(F.max_by(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), F.struct("fame", -F.col("rep"))).alias("h"))
        .select("key", "h.*"),
        "hubs",
    )
    texts = by_ids(_texts(docs, id_col, text_col), fame.select(F.col("rep").alias("doc_id")), "left_semi")
    chosen = classes.select("k1", "k2", F.col("rep").alias("doc_id"))
    sets = scratch.table(shingle_sets(texts, width).join(chosen, ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "items"), "sets")
    star = scratch.table(
        members.join(hubs, "key").where("rep <> hub").select("hub", "hub_n", "rep", "n").distinct(), "star"
    )
    scratch.drop(buckets, members, fame, famous, hubs)
    compared = scratch.table(
        star.join(sets.select(F.col("doc_id").alias("rep"), F.col("items").alias("y")), "rep")
        .join(sets.select(F.col("doc_id").alias("hub"), F.col("items").alias("x")), "hub")
        .select("hub", "hub_n", "rep", "n", F.array_except("x", "y").alias("lost"), F.array_except("y", "x").alias("added"))
        .withColumn("link", (100 + percent) * (F.col("hub_n") - F.size("lost")) >= percent * (F.col("hub_n") + F.col("n"))),
        "compared",
    )
    links = compared.where("link").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    comp = components(links, scratch)
    found = scratch.table(_rays(compared, comp, percent, scratch), "found")
    scratch.drop(star, sets)
    if not found.isEmpty():
        links = links.unionByName(found)
        comp = components(links, scratch)
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.table(named.select("k1", "k2", "n_shingles", "rep", F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = sk.join(named, ["k1", "k2", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"),
        F.coalesce("rep", "doc_id").alias("class_id"),
    )
    if given is not None:
        out = given.join(out.dropDuplicates(["doc_id"]), "doc_id")
    return (out, links) if links_too else out
