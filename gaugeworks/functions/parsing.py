"""Text to numbers, dates and codes.  Bad input gives a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column, default: float | None = 0.0) -> Column:
    """Double value of text; ``default`` for null or unreadable text."""
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(default).cast("double"))


def falsy_to(x: Column, *others: Column, default: object = 0) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in (x, *others)), F.lit(default))


def money(x: Column) -> Column:
    """Dollars of an amount with a final K, M, B or T (thousands to trillions) or without; unreadable text is 0."""
    text = F.upper(F.trim(x.cast("string")))
    scale = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)) for v in p)), F.right(text, F.lit(1))), F.lit(1.0))
    digits = F.regexp_extract(text, r"^(-?[0-9]*\.?[0-9]+)[KMBT]?$", 1)
    return F.coalesce(digits.try_cast("double"), F.lit(0.0)) * scale


def tornado_scale(x: Column, enhanced_only: bool = False) -> Column:
    """The digit of ``EF3`` (and of ``F3`` unless ``enhanced_only``); null when there is none."""
    return F.regexp_extract(F.upper(x), r"^EF(\d+)$" if enhanced_only else r"^E?F(\d)", 1).try_cast("int")


def pad_code(x: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer codes stay whole."""
    text = x.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def county_code(state: Column, county: Column) -> Column:
    """State and county code as five digits; null for the whole state (``000``, blank)."""
    c = pad_code(F.trim(county), 3)
    return F.when(c.isNull() | c.isin("", "000"), F.lit(None)).otherwise(F.concat(pad_code(F.trim(state), 2), c))


def year_prefix(x: Column) -> Column:
    """Leading four digits when they are 1990-2099."""
    y = F.substring(x.cast("string"), 1, 4).try_cast("int")
    return F.when(y.between(1990, 2099), y)


def year_anywhere(x: Column) -> Column:
    """First 19xx or 20xx in the text."""
    return F.regexp_extract(x.cast("string"), r"((?:19|20)\d{2})", 1).try_cast("int")


def year_number(x: Column) -> Column:
    """A whole number of 1900-2099."""
    y = x.cast("string").try_cast("int")
    return F.when(y.between(1900, 2099), y)


def compact_date(year_month: Column, day: Column) -> Column:
    """Date of ``YYYYMM`` and a day number."""
    return F.try_to_date(F.concat(year_month.cast("string"), pad_code(day, 2)), "yyyyMMdd")


def infer_year(month: Column, day: Column, seen_on: Column, grace_days: int = 0) -> Column:
    """Most recent date with this month and day that is no later than ``seen_on`` plus the grace."""
    limit = F.date_add(seen_on, grace_days)

    def dated(back: int) -> Column:
        text = F.concat_ws("-", (F.year(seen_on) - back).cast("string"), pad_code(month, 2), pad_code(day, 2))
        return F.try_to_date(text, "yyyy-MM-dd")

    return F.coalesce(*(F.when(dated(k) <= limit, dated(k)) for k in (0, 1, 2)))


def printed_date(text: Column, seen_on: Column) -> Column:
    """Date of a month's name and a day, as ``Apr 9`` or ``April 9, 2021``; without a year the most recent one not after ``seen_on``, null if unreadable."""
    head, rest = F.get(F.split(text, ","), F.lit(0)), F.trim(F.get(F.split(text, ","), F.lit(1)))
    words = F.split(F.trim(head), r"\s+")
    name, day = F.get(words, F.lit(0)), F.get(words, F.lit(1)).substr(1, 2)
    number = F.coalesce(day.try_cast("int"), F.left(day, F.lit(1)).try_cast("int"))
    month = F.month(F.try_to_date(F.concat(F.initcap(F.left(name, F.lit(3))), F.lit(" 2000")), "MMM yyyy"))
    year = F.when(F.size(words) == 2, F.left(rest, F.lit(4)).try_cast("int"))
    whole = F.try_to_date(F.concat_ws("-", year, pad_code(month, 2), pad_code(number, 2)), "yyyy-MM-dd")
    return F.when(year >= 1000, whole).otherwise(infer_year(month, number, seen_on))


def epoch_date(millis: Column) -> Column:
    """UTC date of epoch milliseconds."""
    return F.to_date(F.timestamp_millis(millis))


def clock_label(x: Column) -> Column:
    """``2:05 PM`` of ``14:05``; null for other text."""
    hour, minute = (F.regexp_extract(x, r"^(\d{1,2}):(\d{2})$", k).try_cast("int") for k in (1, 2))
    label = F.concat(((hour + 11) % 12 + 1).cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.when(hour < 12, " AM").otherwise(" PM"))
    return F.when((hour < 24) & (minute < 60), label)


def grounded(text: Column, name: Column) -> Column:
    """Whether a script names a column as one: after a quote, a dot or a bracket, as a whole word, letter case aside."""
    literal = F.regexp_replace(F.lower(name), r"([^a-z0-9_])", r"\\$1")
    return F.regexp(F.lower(text), F.concat(F.lit("[\"'.\\[]"), literal, F.lit("(?![a-z0-9_])")))
