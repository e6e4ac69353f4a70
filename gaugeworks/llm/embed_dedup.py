"""Near-duplicate embeddings by E8 lattice hashing.

Plan
----
1. Each of ``TABLES`` tables projects the unit vectors on eight random
   directions, divides by ``WIDTH`` and decodes to the nearest E8 lattice point.
   A vector is indexed in its own cell and probes that cell and the ``PROBES``
   nearest neighbouring ones.
2. Vectors that share the cells of two tables with at least ``CROWD`` others form
   a crowd, and those of a crowd that lie within half the threshold's angle of
   its centre form a ball: they link with each other for certain, so a ball
   stands as one entry in all that follows and its links are counted by its
   size.  Other vectors are entries of their own.
3. Index and probe rows of entries meet in a join on (label, table, cell); AQE
   splits crowded cells.  Single vectors carry 128 sign bits, and a pair whose
   bits differ in more than ``BITS`` places, five standard deviations above what
   0.93 gives, goes no further.
4. Every distinct pair of entries is decided by its angle: vectors by their
   cosine in double precision; balls by the angle of their centres and their
   radii, which links all of their members or none.  Only balls in between are
   opened, one side at a time, and their members compared.

At cosine 0.93 a table finds a pair with a chance above 0.45, so 12 tables miss
fewer than one in a thousand, and closer pairs are missed far less often.
Equal vectors of one label are one class, which stands as one row in all of
this; links of a class count with the class sizes.  The components follow from
one link for each member of a ball and one for each pair of entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import e8
from .arrow import mapped
from .components import components
from .store import Scratch
from .words import mix, odd_constants

COSINE, TABLES, WIDTH, PROBES, BITS, CROWD = 0.93, 12, 1.2, 8, 34, 4
#: Angles this close to a bound are decided vector by vector.
_MARGIN = 1e-6
_SEED = 20240805


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, safe for huge and tiny entries."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepared(tables: int, width: float, probes: int):
    """Per row: validity, class key, raw bytes, sign bits, own cells, probed cells and cell pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                yield one(whole.slice(at, 1024))

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        column = part.column("embedding")
        kind = np.dtype(column.type.value_type.to_pandas_dtype())
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        gone = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.to_numpy(zero_copy_only=False).astype(kind, copy=True)
        values[gone] = np.nan
        ends = np.concatenate([[0], np.cumsum(size)])
        label = part.column("label").fill_null(0).to_numpy(zero_copy_only=False)
        known = part.column("label").is_valid().to_numpy(zero_copy_only=False)
        ok = np.zeros(n, dtype=bool)
        raw: list[bytes | None] = [None] * n
        bits = np.zeros((n, 2), dtype=np.int64)
        own = np.zeros((n, tables), dtype=np.int64)
        probe = np.zeros((n, tables * (probes + 1)), dtype=np.int64)
        key = np.zeros((n, 2), dtype=np.int64)
        for d in np.unique(size[size > 0]):
            rows = np.flatnonzero((size == d) & known)
            x = values[ends[rows][:, None] + np.arange(d)[None, :]]
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            rows, x = rows[fine], x[fine] + 0  # -0 becomes 0
            if not len(rows):
                continue
            ok[rows] = True
            u = _unit(x)
            rng = np.random.default_rng([_SEED, int(d)])
            signs = u @ rng.normal(size=(d, 128)) > 0
            bits[rows] = np.packbits(signs, axis=1, bitorder="little").view("<i8")
            salt = mix(label[rows].astype(np.int64).view(np.uint64) + odd_constants(1, int(d)))
            for t in range(tables):
                y = u @ rng.normal(size=(d, 8)) / width
                cell = e8.nearest(y)
                near = np.concatenate([cell[:, None, :], e8.around(y, cell, probes)], axis=1)
                k = mix(e8.keys(near, 1000 + t).view(np.uint64) ^ salt[:, None]).view(np.int64)
                own[rows, t] = k[:, 0]
                probe[rows, t * (probes + 1) : (t + 1) * (probes + 1)] = k
            for i, v in zip(rows, x, strict=True):
                raw[i] = v.tobytes()
                key[i] = np.frombuffer(hashlib.blake2b(raw[i], digest_size=16).digest(), dtype=np.int64)

        def lists(a: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(ok * a.shape[1])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(a[ok].ravel()))

        some = own[:, : tables // 2 * 2].view(np.uint64)
        two = mix(some[:, ::2] * odd_constants(1, 3) + some[:, 1::2]).view(np.int64) if tables > 1 else own
        arrays = [part.column("vec_id"), part.column("label"), pa.array(ok), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(raw, pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), lists(own), lists(probe), lists(two)]
        return pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "ok", "k1", "k2", "raw", "s1", "s2", "own", "probe", "two"])

    return run


def _cosines(x: list[bytes], y: list[bytes], kind: str) -> np.ndarray:
    """Cosines of pairs of vectors of equal lengths, in double precision."""
    size, value = np.array([len(v) for v in x]), np.zeros(len(x))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        a, b = (_unit(np.frombuffer(b"".join(s[i] for i in rows), dtype=kind).reshape(len(rows), -1)) for s in (x, y))
        value[rows] = (a * b).sum(axis=1)
    return value


def _summed(kind: str):
    """Of (crowd, raw) the sums of unit vectors, as far as a batch reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            crowd, at = np.unique(batch.column("crowd").to_numpy(), return_inverse=True)
            u = _unit(np.frombuffer(b"".join(batch.column("raw").to_pylist()), dtype=kind).reshape(batch.num_rows, -1))
            total = np.zeros((len(crowd), u.shape[1]))
            np.add.at(total, at, u)
            ends = pa.array(np.arange(len(crowd) + 1, dtype=np.int32) * u.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(crowd), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=["crowd", "total"])

    return run


def _angled(kind: str):
    """Of (vec_id, crowd, size, raw, total) the angle of each vector to the direction of its crowd's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre = [np.array(v, dtype=kind).tobytes() for v in batch.column("total").to_pylist()]
            angle = np.arccos(np.clip(_cosines(batch.column("raw").to_pylist(), centre, kind), -1, 1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("crowd"), batch.column("size"), pa.array(centre, pa.binary()), pa.array(angle)], names=["vec_id", "crowd", "size", "centre", "angle"])

    return run


def _decided(kind: str, cosine: float):
    """Of (a, b, x, y, radii) the pairs that link (all members with all) or are open."""
    limit = float(np.arccos(cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                value = _cosines(*(part.column(c).to_pylist() for c in ("x", "y")), kind)
                radii = part.column("radii").to_numpy()
                angle = np.arccos(np.clip(value, -1, 1))
                alone = radii == 0
                every = np.where(alone, value >= cosine, angle + radii <= limit - _MARGIN)
                open_ = ~alone & ~every & (angle - radii <= limit + _MARGIN)
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(open_)], names=["a", "b", "open"])
                yield out.filter(pa.array(every | open_))

    return run


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    tables: int = TABLES,
    width: float = WIDTH,
    probes: int = PROBES,
    links_too: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, component_id, kept) for each row of ``rows``.

    Vectors are compared when their labels are equal and not null, and linked
    when the search finds them and their cosine is at least ``cosine``.
    Vectors that are null, empty, all zero, or hold a null or non-finite entry
    link with nothing; so do vectors of unlike lengths.  Equal vectors of one
    label always link.  Rows with a null id are left out; rows that share an id
    are counted one by one, and of unlike vectors under one id the one of least
    (label, key) is searched for.  An empty table gives an empty result; other
    columns are not read.  With ``links_too`` links that span the components
    come second: (a, b), a and b the least ids of two classes.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label")).where("vec_id is not null")
    kind = "f4" if given.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    if kind == "f8":
        given = given.withColumn("embedding", F.col("embedding").cast("array<double>"))
    schema = "vec_id long, label long, ok boolean, k1 long, k2 long, raw binary, s1 long, s2 long, own array<long>, probe array<long>, two array<long>"
    every = scratch.table(mapped(given, _prepared(tables, width, probes), schema), "prepared")
    key = ["label", "k1", "k2"]
    classes = scratch.table(every.where("ok").groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size")), "classes")
    chosen = classes.groupBy("vec_id").agg(F.min(F.struct(*key, "size")).alias("c")).select("vec_id", "c.*")
    one = scratch.table(every.where("ok").join(chosen, [*key, "vec_id"]).dropDuplicates(["vec_id"]), "searched")
    members = scratch.table(_balls(one, kind, cosine, scratch), "members")
    balls = scratch.table(members.groupBy("entry").agg(F.max("angle").alias("radius"), F.sum("size").alias("weight"), F.first("centre").alias("raw")), "balls")

    single = one.join(members.select("vec_id"), "vec_id", "left_anti")
    inside = one.join(members.select("vec_id", "entry"), "vec_id")
    entries = single.select(F.col("vec_id").alias("entry"), "raw", F.lit(0.0).alias("radius"), F.col("size").alias("weight")).unionByName(balls.select("entry", "raw", "radius", "weight"))
    entries = scratch.table(entries, "entries")

    def cells(kind_: str) -> DataFrame:
        alone = single.select(F.explode(kind_).alias("cell"), "label", F.col("vec_id").alias("entry"), "s1", "s2")
        crowded = inside.select(F.explode(kind_).alias("cell"), "label", "entry").distinct()
        return alone.unionByName(crowded.select("cell", "label", "entry", F.lit(None).cast("long").alias("s1"), F.lit(None).cast("long").alias("s2")))

    index = cells("own").select("cell", "label", F.col("entry").alias("a"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    probe = cells("probe").select("cell", "label", F.col("entry").alias("b"), F.col("s1").alias("q1"), F.col("s2").alias("q2"))
    differ = F.bit_count(F.col("p1").bitwiseXOR(F.col("q1"))) + F.bit_count(F.col("p2").bitwiseXOR(F.col("q2")))
    met = index.join(probe, ["cell", "label"]).where((F.col("a") != F.col("b")) & (F.coalesce(differ, F.lit(0)) <= BITS))
    pairs = scratch.table(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    def decided(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Pairs that link in full, and open ones; the sides are (entry, raw, radius)."""
        x = left.select(F.col("entry").alias("a"), F.col("raw").alias("x"), F.col("radius").alias("rx"))
        y = right.select(F.col("entry").alias("b"), F.col("raw").alias("y"), F.col("radius").alias("ry"))
        both = pairs.join(x, "a").join(y, "b").where("length(x) = length(y)").select("a", "b", "x", "y", (F.col("rx") + F.col("ry")).alias("radii"))
        found = scratch.table(mapped(both, _decided(kind, cosine), "a long, b long, open boolean"), name)
        return found.where("not open").select("a", "b"), found.where("open").select("a", "b")

    vectors = one.select(F.col("vec_id").alias("entry"), "raw", F.lit(0.0).alias("radius"))
    held = members.select("entry", "vec_id").unionByName(single.select(F.col("vec_id").alias("entry"), "vec_id"))
    full, open_ = decided(pairs, entries, entries, "whole")
    # the members of one side against the other as a whole, then vector by vector
    half_full = links = full.limit(0)
    if not open_.isEmpty():
        half = open_.join(held.select(F.col("entry").alias("a"), F.col("vec_id").alias("v")), "a").select(F.col("v").alias("a"), "b")
        half_full, half_open = decided(scratch.table(half, "half"), vectors, entries, "halves")
        each = half_open.join(held.select(F.col("entry").alias("b"), F.col("vec_id").alias("v")), "b").select("a", F.col("v").alias("b"))
        links, _ = decided(scratch.table(each, "each"), vectors, vectors, "links")
    scratch.drop(pairs)

    weight, size = entries.select("entry", "weight"), one.select(F.col("vec_id").alias("entry"), F.col("size").alias("weight"))

    def added(found: DataFrame, to: str, of: str, weights: DataFrame) -> DataFrame:
        return found.select(F.col(to).alias("to"), F.col(of).alias("entry")).join(weights, "entry").select("to", "weight")

    to_entries = added(full, "a", "b", weight).unionByName(added(full, "b", "a", weight)).unionByName(added(half_full, "b", "a", size))
    to_vectors = added(half_full, "a", "b", weight).unionByName(added(links, "a", "b", size)).unionByName(added(links, "b", "a", size))
    to_entries = scratch.table(to_entries.groupBy(F.col("to").alias("entry")).agg(F.sum("weight").alias("around")), "to_entries")
    to_vectors = scratch.table(to_vectors.groupBy(F.col("to").alias("vec_id")).agg(F.sum("weight").alias("near")), "to_vectors")
    span = members.select(F.col("vec_id").alias("a"), F.col("entry").alias("b")).where("a <> b").unionByName(full).unionByName(half_full).unionByName(links)
    span = scratch.table(span, "span")
    comp = components(span, scratch)
    zero = F.lit(0)
    inner = held.join(one.select("vec_id", "size", *key), "vec_id").join(balls.select("entry", F.col("weight").alias("ball")), "entry", "left").join(to_entries, "entry", "left").join(to_vectors, "vec_id", "left")
    n_links = F.coalesce(F.col("ball") - F.col("size"), zero) + F.coalesce("around", zero) + F.coalesce("near", zero)
    named = classes.join(inner.select(*key, n_links.alias("far")), key, "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    named = scratch.table(
        named.select(*key, (F.col("size") - 1 + F.coalesce("far", zero)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.lit(True).alias("ok")), "named"
    )
    out = (
        every.select("vec_id", "ok", *key)
        .join(named, [*key, "ok"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("component_id") == F.col("vec_id"))
    )
    return (out, span) if links_too else out


def _balls(one: DataFrame, kind: str, cosine: float, scratch: Scratch) -> DataFrame:
    """(vec_id, entry, size, angle, centre) of the vectors in balls; ``entry`` is the least id of the ball."""
    pairs = one.select("vec_id", F.explode("two").alias("crowd"))
    crowds = scratch.table(pairs.groupBy("crowd").agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "crowds")
    if crowds.isEmpty():
        return one.select("vec_id", F.col("vec_id").alias("entry"), "size", F.lit(0.0).alias("angle"), F.col("raw").alias("centre")).limit(0)
    best = pairs.join(crowds, "crowd").groupBy("vec_id").agg(F.max(F.struct("n", "crowd")).alias("c")).select("vec_id", F.col("c.crowd").alias("crowd"))
    crowded = scratch.table(best.join(one.select("vec_id", "size", "raw"), "vec_id"), "crowded")
    # sums of batches first, then of places: a crowd of any size is a few rows
    sums = mapped(crowded.select("crowd", "raw"), _summed(kind), "crowd long, total array<double>").select("crowd", F.posexplode("total").alias("k", "v")).groupBy("crowd", "k").agg(F.sum("v").alias("v"))
    centres = scratch.table(sums.groupBy("crowd").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("t")).select("crowd", F.col("t.v").alias("total")), "centres")
    angles = scratch.table(mapped(crowded.join(centres, "crowd"), _angled(kind), "vec_id long, crowd long, size long, centre binary, angle double"), "angles")
    near = angles.where(F.col("angle") <= float(np.arccos(cosine)) / 2 - _MARGIN)
    entry = scratch.table(near.groupBy("crowd").agg(F.min("vec_id").alias("entry"), F.count("*").alias("n")).where("n > 1").select("crowd", "entry"), "entries")
    return near.join(entry, "crowd").select("vec_id", "entry", "size", "angle", "centre")
