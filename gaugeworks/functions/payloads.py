"""Values out of documents that have no fixed schema: script assignments and JSON of unknown shape."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quoted strings, single brackets, stretches of other characters; a quote that is never closed stands alone.
_TOKENS = r"""'[^']*'|"[^"]*"|[\[\]]|[^\[\]'"]+|['"]"""
#: Keys that state a document's date, in the order in which they count.
DATE_KEYS = ("dataAsOf", "generatedAt", "generated", "builtAt", "briefDate")
#: Sections that may state it instead.
SECTIONS = ("meta", "coverage")
_ISO_DATE = r"\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b"
#: A JSON string, and the colon that follows it where it is a key; other text of a JSON document holds no quotes.
_JSON_STRING = r'"(?:\\.|[^"\\])*":?'


def bracketed(text: Column, name: str) -> Column:
    """The bracketed list that follows the first ``name`` in a script, up to the bracket that closes it.

    The running depth of brackets is an aggregate over tokens, so nested lists
    are taken whole; brackets within quotes are text.  Null if the name or a
    bracket after it is missing, or if the list is cut off before it closes.
    """
    after = F.when(F.instr(text, name) > 0, F.substr(text, F.instr(text, name) + F.lit(len(name))))
    tail = F.when(F.instr(after, "[") > 0, F.substr(after, F.instr(after, "[")))
    tokens = F.regexp_extract_all(tail, F.lit(_TOKENS), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def step(a: Column, t: Column) -> Column:
        depth = a["depth"] + F.when(t == "[", 1).when(t == "]", -1).otherwise(0)
        return F.when(a["closed"], a).otherwise(F.struct(depth.alias("depth"), (a["size"] + F.length(t)).alias("size"), (depth == 0).alias("closed")))

    end = F.aggregate(tokens, start, step)
    return F.when(end["closed"], F.substr(tail, F.lit(1), end["size"]))


def script_list(text: Column, name: str, of: str) -> Column:
    """``bracketed`` as an array of type ``of``, single quotes read as double ones; null if it is no such list."""
    return F.from_json(F.replace(bracketed(text, name), F.lit("'"), F.lit('"')), f"array<{of}>")


def labelled_rows(values: Column, labels: Column, standard: Sequence[str]) -> Column:
    """(label, row) of a matrix whose labels are listed apart.

    Where the labels are missing, or are not as many as the rows, the
    ``standard`` ones stand in if they are as many; else the result is null.
    """
    fixed = F.array(*map(F.lit, standard))
    fits = F.size(labels) == F.size(values)
    names = F.when(fits & (F.size(labels) > 0), labels).when(F.size(values) == len(standard), fixed)
    return F.when(names.isNotNull(), F.arrays_zip(names.alias("label"), values.alias("row")))


def whole_days(label: Column) -> Column:
    """Days of a duration label ('2-day': 2); null for hours, minutes and anything else."""
    text = F.lower(F.trim(label))
    number = F.trim(F.replace(F.replace(text, F.lit("-day"), F.lit("")), F.lit("day"), F.lit("")))
    return F.when(text.endswith("day"), number.try_cast("double").cast("int"))


def _with(value: Column, to: Callable[[Column], Column]) -> Column:
    """``to(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), to), F.lit(0))


def _text(value: Column) -> Column:
    """A variant as text; null for null, empty, zero, false, a list or an object."""

    def told(x: Column) -> Column:
        kind, text = x["kind"], x["text"]
        empty = ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false")) | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (text.try_cast("double") == 0)) | kind.rlike("^(ARRAY|OBJECT)")
        return F.when(~empty, text)

    return _with(value, lambda v: _with(F.struct(F.schema_of_variant(v).alias("kind"), v.try_cast("string").alias("text")), told))


def _stated(doc: Column, path: str) -> Column:
    return _text(F.try_variant_get(doc, path, "variant"))


def _key_date(doc: Column, at: str) -> Column:
    return F.coalesce(*(_stated(doc, f"{at}.{k}") for k in DATE_KEYS))


def _newest_part(doc: Column, at: str) -> Column:
    dates = F.map_values(F.try_variant_get(doc, f"{at}.asOf", "map<string,variant>"))
    return F.array_max(F.filter(F.transform(dates, _text), lambda x: x.isNotNull()))


def newest_date(doc: Column, today: Column | str) -> Column:
    """The newest ISO date not after ``today`` in any string of a variant, at any depth; keys do not count."""
    strings = F.filter(F.regexp_extract_all(F.to_json(doc), F.lit(_JSON_STRING), F.lit(0)), lambda s: ~s.endswith(":"))
    dates = F.flatten(F.transform(strings, lambda s: F.regexp_extract_all(s, F.lit(_ISO_DATE), F.lit(1))))
    return F.array_max(F.filter(dates, lambda x: x <= today))


def freshness_date(doc: Column, today: Column | str) -> Column:
    """(way, date) that tells how fresh a document (a variant) is.

    In this order: the first of ``DATE_KEYS`` that is set or else the largest
    value of its ``asOf`` (ways ``key`` and ``as of``), the same in one of ``SECTIONS``, with
    its ``to`` as last resort (``section``), the newest date not after ``today``
    in any of its strings (``newest``).  Null if it has none; lists and objects
    are no dates, nor are empty strings, 0 and false.
    """

    def way(name: str, date: Column) -> Column:
        return _with(date, lambda x: F.when(x.isNotNull(), F.struct(F.lit(name).alias("way"), x.alias("date"))))

    # the first that there is; the others are not computed
    sections = [way("section", found) for s in SECTIONS for found in (_key_date(doc, f"$.{s}"), _newest_part(doc, f"$.{s}"), _stated(doc, f"$.{s}.to"))]
    return F.coalesce(way("key", _key_date(doc, "$")), way("as of", _newest_part(doc, "$")), *sections, way("newest", newest_date(doc, today)))
