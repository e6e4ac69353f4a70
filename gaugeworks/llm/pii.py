"""Personal data: direct identifiers by pattern, and terms that reveal them by co-occurrence.

Plan
----
1. A pass over whole texts finds e-mail addresses, IP addresses, card and phone
   numbers.  These are the protected entities.  With each entity go the terms
   within ``WINDOW`` words of it and a hash of that context.
2. How strongly a term t reveals an entity c is their pointwise mutual
   information over documents, pmi = log2(N joint / (df(c) df(t))), against the
   entity's own information, ic = log2(N / df(c)).  pmi = ic says that t never
   occurs without c near it.  t discloses c where pmi >= ``SHARE`` * ic, with two
   documents and two different contexts at least as evidence, so that exact
   copies of one passage are none.
3. A disclosing term is generalised to its class (its first two characters, or
   its shape where it has digits) if the class itself discloses none of the
   entities that the term does, else removed.

Only entities of two documents or more and their terms are counted, and only
documents with a disclosing term are read again.  Counts are partial sums per
task; a table is broadcast after a count of its rows (``store.looked_up``).

Defined results: null and empty texts hold nothing; each row is a document,
rows that share an id or repeat included; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .store import Scratch, by_ids, looked_up

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as its context; share of the entity's information that may not be disclosed.
WINDOW, SHARE = 8, 0.9
#: Classes of terms that a task remembers at most.
HELD = 200_000
#: What is trimmed from a term's ends.
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does; possessive, so that long runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = re.compile("[ -]")


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: all that may stand before the at sign, back to the last address, and the domain."""
    free = 0
    for m in _DOMAIN.finditer(text):
        begin = m.start()
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < m.start():
            free = m.end()
            yield begin, free


def entities(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all direct identifiers, by kind, then start; places in code points."""
    found = [("email", a, b, text[a:b].lower()) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            found.append(("ip", m.start(), m.end(), m.group()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _SPACES.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end(), digits))
    for m in _PHONE.finditer(text):
        digits = "".join(c for c in m.group() if c.isdigit())
        if 8 <= len(digits) <= 15:
            found.append(("phone", m.start(), m.end(), digits))
    return found


def term_of(word: str) -> str:
    return word.strip(EDGE).encode("utf-8", "replace").lower().decode()  # of bytes: lowers A-Z alone


def class_of(term: str) -> str:
    """The more general form of a term: digits unnamed, or the first two characters."""
    return re.sub("[0-9]", "#", term) if re.search("[0-9]", term) else term[:2] + "*"


def row_terms(docs: DataFrame, classes: bool) -> DataFrame:
    """(row_key, term, plain) for every row of ``docs`` (row_key, text) and each distinct term, with ``classes`` each class too."""
    edge = EDGE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            plain, general = [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                terms = {w.strip(edge) for w in set((text or b"").lower().split())} - {b""}
                plain.append(list(terms))
                if classes:
                    for t in (t for t in terms if t not in known):
                        known[t] = class_of(t.decode("utf-8", "replace")).encode()
                    general.append(list({known[t] for t in terms}))
                    if len(known) > HELD:
                        known.clear()
                else:
                    general.append([])
            listed = [pa.array(x, pa.list_(pa.binary())).cast(pa.list_(pa.string())) for x in (plain, general)]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), *listed], ["row_key", "plain", "general"])

    found = mapped(docs.select("row_key", "text"), run, "row_key bigint, plain array<string>, general array<string>")

    def marked(words: str, plain: bool) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(plain).alias("plain")))

    return found.select("row_key", F.explode(F.concat(marked("plain", True), marked("general", False))).alias("t")).select("row_key", "t.term", "t.plain")


def _class(term: Column) -> Column:
    """As ``class_of``."""
    return F.when(term.rlike("[0-9]"), F.regexp_replace(term, "[0-9]", "#")).otherwise(F.concat(F.substring(term, 1, 2), F.lit("*")))


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_NEAR = "array<struct<kind:string,value:string,terms:array<struct<term:string,plain:boolean,lo:bigint,hi:bigint>>>>"
_PA_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_PA_NEAR = pa.list_(
    pa.struct([("kind", pa.string()), ("value", pa.string()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("plain", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64())])))])
)


def contexts(text: str, found: list[tuple[str, int, int, str]], window: int) -> list[dict]:
    """The entities of a text, each once, with the terms near it and the least and largest hash of their contexts."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken = set()
    for _, a, b, _ in found:
        taken.update(range(bisect_left(ends, a + 1), bisect_left(starts, b)))
    free = [i for i in range(len(words)) if i not in taken]
    near: dict[tuple[str, str], dict[tuple[str, bool], tuple[int, int]]] = {}
    for kind, a, b, value in found:
        i, j = bisect_left(free, bisect_left(ends, a + 1)), bisect_left(free, bisect_left(starts, b))
        terms = [t for k in free[max(0, i - window) : i] + free[j : j + window] if (t := term_of(text[slice(*words[k])]))]
        h = int.from_bytes(hashlib.blake2b(" ".join(terms).encode(), digest_size=8).digest(), "little", signed=True)
        of = near.setdefault((kind, value), {})
        for t in [(t, True) for t in terms] + [(class_of(t), False) for t in terms]:
            lo, hi = of.get(t, (h, h))
            of[t] = min(lo, h), max(hi, h)
    return [{"kind": k, "value": v, "terms": [{"term": t, "plain": p, "lo": lo, "hi": hi} for (t, p), (lo, hi) in of.items()]} for (k, v), of in near.items()]


def _with_key(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a key of the row; equal rows have equal keys, and equal results."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))


def found_entities(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row_key, spans, near) of every row: direct identifiers and the terms around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, near = [], []
            for text in batch.column("text").to_pylist():
                found = entities(text) if text else []
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in found])
                near.append(contexts(text, found, window) if found else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(spans, _PA_SPAN), pa.array(near, _PA_NEAR)], ["doc_id", "row_key", "spans", "near"])

    kept = _with_key(docs)
    return mapped(kept, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, spans {_SPAN}, near {_NEAR}")


def disclosing_terms(docs: DataFrame, found: DataFrame, scratch: Scratch, share: float = SHARE) -> DataFrame:
    """(term, form) of all terms of ``docs`` that disclose an entity of the written table ``found``; form null: to be removed."""
    rows = found.count()
    near = found.select(F.explode("near").alias("e")).select("e.kind", "e.value", "e.terms")
    known = scratch.table(near.groupBy("kind", "value").agg(F.count("*").alias("df_c")).where("df_c > 1"), "entities")
    together = (
        looked_up(near, known, ["kind", "value"])
        .select("kind", "value", "df_c", F.explode("terms").alias("t"))
        .groupBy("kind", "value", "df_c", "t.term", "t.plain")
        .agg(F.count("*").alias("joint"), F.min("t.lo").alias("lo"), F.max("t.hi").alias("hi"))
        .where("joint > 1 and lo < hi")
    )
    together = scratch.table(together.drop("lo", "hi"), "together")
    asked = scratch.table(together.select("term", "plain").distinct(), "asked")
    counted = scratch.table(looked_up(row_terms(_with_key(docs), True), asked, ["term", "plain"]).groupBy("term", "plain").agg(F.count("*").alias("df_t")), "counted")
    pmi, ic = F.log2(F.lit(float(rows)) * F.col("joint") / (F.col("df_c") * F.col("df_t"))), F.log2(F.lit(float(rows)) / F.col("df_c"))
    judged = scratch.table(together.join(counted, ["term", "plain"]).select("kind", "value", "term", "plain", ((ic > 0) & (pmi >= F.lit(share) * ic - 1e-9)).alias("discloses")), "judged")
    plain = judged.where("plain and discloses").select("kind", "value", "term", _class(F.col("term")).alias("form"))
    general = judged.where("not plain").select("kind", "value", F.col("term").alias("form"), F.col("discloses").alias("still"))
    return plain.join(general, ["kind", "value", "form"], "left").groupBy("term").agg(F.max(F.coalesce("still", F.lit(True))).alias("still"), F.first("form").alias("form")).select("term", F.when(~F.col("still"), F.col("form")).alias("form"))


def personal_data(docs: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text): kind, start, end and form, places in code points.

    Spans of the four kinds of identifiers come first, by kind, then start; then
    those of disclosing terms (kind ``term``), by start, where no identifier
    stands.  ``form`` is what should stand instead: the kind in brackets, a
    term's class, or null if it is to be removed.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.table(found_entities(docs, window), "found")
    terms = scratch.table(disclosing_terms(docs, found, scratch, share), "terms")
    keyed = _with_key(docs)
    hits = scratch.table(looked_up(row_terms(keyed, False).drop("plain"), terms, "term").distinct().groupBy("row_key").agg(F.collect_list(F.struct("term", "form")).alias("terms")), "hits")
    keys = scratch.table(hits.select("row_key"), "keys")
    again = by_ids(keyed, keys, "left_semi").select("row_key", "text").dropDuplicates(["row_key"]).join(hits, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                forms = {t["term"]: t["form"] for t in terms}
                taken = sorted((a, b) for _, a, b, _ in entities(text))
                reach, most = [], 0  # of the identifiers up to each, where the last one ends
                for _, b in taken:
                    most = max(most, b)
                    reach.append(most)
                spans = []
                for m in _WORD.finditer(text):
                    t = term_of(m.group())
                    if t in forms:
                        a = m.end() - len(m.group().lstrip(EDGE))
                        b = m.start() + len(m.group().rstrip(EDGE))
                        k = bisect_left(taken, (b, 0))
                        if not k or reach[k - 1] <= a:
                            spans.append({"kind": "term", "start": a, "end": b, "form": forms[t]})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(out, _PA_TERM)], ["row_key", "more"])

    more = scratch.table(mapped(again, run, f"row_key bigint, more {_FORMED}"), "more")
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("form")))
    return looked_up(found.select("doc_id", "row_key", base.alias("spans")), more, "row_key", "left").select("doc_id", "row_key", F.concat("spans", F.coalesce("more", F.array().cast(_FORMED))).alias("spans"))


_FORMED = "array<struct<kind:string,start:bigint,end:bigint,form:string>>"
_PA_TERM = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("form", pa.string())]))


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with the spans of ``personal_data`` replaced by their forms; overlapping spans become one, under the first one's form."""
    spans = found.where(F.size("spans") > 0).select("row_key", "spans").dropDuplicates(["row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], s["form"] or ""]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.large_string())], ["doc_id", "text"])

    rows = _with_key(docs).join(spans, "row_key", "left").select("doc_id", "text", "spans")
    return mapped(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query's contract from ``personal_data``."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "term")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("term"),
    )
